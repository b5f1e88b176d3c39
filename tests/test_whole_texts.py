"""Registered queries read whole texts."""

from scriptorium.plans import catalogue


def _tables(spark, folder, docs, items=()):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_an_answer_after_the_first_400_characters_ranks_in_both_branches(spark, tmp_path):
    # Every document has the question's words; four short ones hold one of them early, document 9 holds all late.
    late = "filler " * 80 + "the quartz heron ledger glows"
    docs = [(i, f"the quartz {i}", "en", "s", 10) for i in range(1, 7)] + [(9, late, "en", "s", len(late))]
    folder = _tables(spark, tmp_path / "sf", docs, [(1, "the quartz heron ledger glows")])
    row = catalogue.answered_questions(spark, folder).collect()[0]
    assert row["evidence"].split(",")[0].startswith("9:")


def test_cases_are_extracted_from_the_text_itself(spark, tmp_path):
    docs = [(1, "alpha beta gamma\ndelta epsilon zeta eta", "en", "web", 1), (2, "one two three four", None, "web", 1), (3, "same same same same", "en", "web", 99), (4, None, "en", "web", 99)]
    found = {r["chunk_id"]: r for r in catalogue.extracted_cases(spark, _tables(spark, tmp_path / "sf", docs)).collect()}
    assert set(found) == {"d1", "d2"}
    assert found["d1"]["title"] == "alpha beta gamma delta epsilon zeta" and found["d1"]["section_keys"] == "web,en" and found["d2"]["section_keys"] == "web"
