"""Files of records, vectors, normalised records, reports: what no registered query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import audit, cases, extraction, intent, merging, report, retrieval, sections, tagging
from scriptorium.sources import files


def test_json_families(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "array.jsonl").write_text(" \n" + json.dumps(rows, indent=1))
    (tmp_path / "bad.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n')
    read = lambda name, **o: sorted((r["a"], r["b"]) for r in files.json_family(spark, str(tmp_path / name), "a int, b string", **o).collect())
    assert read("lines.json") == read("array.jsonl") == [(1, "x"), (2, None)]
    assert read("bad.jsonl") == [(1, "x")]
    with pytest.raises(Exception):
        read("bad.jsonl", strict=True)


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,\"b\""), (2, "é")], "n int, t string")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", True).schema("n int, t string").option("escape", "\"").csv(str(tmp_path / "csv")).collect())) == [(1, 'a,"b"'), (2, "é")]
    files.write_json(rows, str(tmp_path / "json"))
    files.write_json(rows, str(tmp_path / "json"), append=True)
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    assert files.is_current(spark, str(tmp_path / "json"), str(tmp_path / "csv")) and not files.is_current(spark, str(tmp_path / "none"), str(tmp_path / "csv"))
    assert [r["n"] for r in files.selected_rows(rows, "n", 2).collect()] == [2] and files.selected_rows(rows, "n", 0, 1).first()["n"] == 1 and files.selected_rows(rows, "n", id_col="t", id_value="é").first()["n"] == 2
    (tmp_path / "book.txt").write_text("目录\n第一\r\n第二", encoding="utf-8")
    assert [r["text"] for r in files.whole_text(spark, str(tmp_path / "book.txt")).orderBy("line").collect()] == ["目录", "第一", "第二"]


def test_stored_vectors_are_reused_until_the_rows_change(spark, tmp_path):
    def encoded(texts):
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([("a", "xx"), ("b", None)], "id string, text string")
    read = lambda of, f: {r["id"]: r["vector"] for r in files.stored_vectors(spark, str(tmp_path), of, "id", "text", f).collect()}
    assert read(rows, encoded) == {"a": [2.0, 1.0], "b": [0.0, 1.0]}
    assert read(rows, lambda texts: 1 / 0) == {"a": [2.0, 1.0], "b": [0.0, 1.0]}
    assert read(rows.where("id = 'a'"), encoded) == {"a": [2.0, 1.0]}


def test_records(spark):
    rows = spark.createDataFrame([(" a ", None, [" x", "x", ""], None), (None, "b", None, 0.3)], "t string, u string, l array<string>, s double")
    found = merging.normalized_records(rows, ["t", "u"], ["l"], {"s": 0.85}).collect()
    assert [(r["t"], r["u"], r["l"], r["s"]) for r in found] == [("a", "", ["x"], 0.85), ("", "b", [], 0.3)]
    both = merging.consolidated([rows.select("t"), rows.select("u", "t")]).collect()
    assert len(both) == 4 and sum(r["u"] is None for r in both) == 3
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["卷一", "卷一", "正文。", "卷二", "正文二。", "正文二。"])], "doc string, line int, text string")
    assert sorted((r["volume"], r["text"]) for r in sections.original_paragraphs(lines, "^卷.$").collect()) == [(1, "正文。"), (2, "正文二。")]


def test_tags_and_reports(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tagging.chunk_type(F.lit(" 臣光曰：甲"))) == "commentary" and one(tagging.people(F.lit("魏文侯问李克"), ["侯"], ["李克"])) == ["魏文侯", "李克"]
    assert one(retrieval.matched(F.lit("a b c"), ["b", "z", "c"])) == ["b", "c"] and one(X.compact(F.lit("A b　C"))) == "abc"
    people = one(intent.actors(F.lit("领导和同事")))
    assert [p["name"] for p in people] == ["我", "直属领导", "同事"] and people[0]["goal"] != people[1]["goal"]
    assert one(cases.mapping_reason(F.lit("团队冲突"), F.array(F.lit("用人")))).startswith("该史例对应关键岗位") and one(cases.mapping_reason(F.lit("x"), F.array(F.lit("用人")))).startswith("该史例与当前问题")
    told = F.array(F.struct(F.lit("").alias("focus"), F.lit("t").alias("title")))
    assert one(report.recommendation(F.lit("s"), told, {"s": "by scene"}, "d")) == "t" and one(report.recommendation(F.lit("s"), F.slice(told, 1, 0), {"s": "by scene"}, "d")) == "by scene"
    page = report.markdown_report(spark.range(1).select(F.lit("q").alias("q"), F.lit("j").alias("j"), F.lit("a").alias("a"), F.array(F.lit("e" * 300)).alias("e")), "T", "q", "j", "a", "e").first()["markdown"]
    assert page.startswith("# T\n\n> q") and page.endswith("- " + "e" * 217 + "...")
    assert one(merging.modern_role(F.lit("上卿"), F.lit(""), F.lit("蔺相如"))) == "新晋高位者/主动避让者" and one(merging.canonical_role(F.lit("叛将甲"))) == "一线负责人/关键执行者"
    low = audit.lowest(spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.2)], "id int, score double"), "score", 0.5, "id", 1)
    assert [r["id"] for r in low.collect()] == [1]


def test_questions_for_evaluation(spark):
    rows = spark.createDataFrame([("c1", "T1", "S", "k"), ("c2", "T2", "S", "k")], "case_id string, title string, summary string, case_type string")

    def model(texts):
        if "T2" in texts[0]:
            raise ValueError("no")
        return ["1. first?\n\n- second?"]

    found = extraction.question_rows(rows, model, "ask {{title}} {{summary}}").collect()
    assert sorted((r["query"], r["expected_id"]) for r in found) == [("first?", "c1"), ("second?", "c1")]
