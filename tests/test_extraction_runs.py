"""Runs of an extraction: failures by turns, rows asked again, sinks and resume."""

import json
import threading
import time

from pyspark.sql import functions as F

from scriptorium.operators import extraction

PROMPTS = [("a", "good"), ("b", "bad once"), ("c", "raises twice"), ("d", "never"), ("e", None), ("f", "")]


def _model():
    seen: dict[str, int] = {}

    def model(texts):
        text = texts[0]
        n = seen[text] = seen.get(text, 0) + 1
        if text == "raises twice" and n <= 2:
            raise TimeoutError("late")
        if text == "never" or text == "bad once" and n == 1:
            return ["no json here"]
        return ["```json\n" + json.dumps({"cases": [{"title": f"t {text}", "score": "0.9", "section_keys": ["s1", "x"]}, {"title": "weak", "score": "0.1"}]}) + "\n```"]

    return model


def test_only_failed_rows_are_asked_again(spark):
    rows = spark.createDataFrame([(i, ["s1"], p, "kept") for i, p in PROMPTS], "chunk_id string, section_keys array<string>, prompt string, answer string").coalesce(1)
    found = {r["chunk_id"]: (r["error_type"], r["tries"], r["answer"] is not None) for r in extraction.answered_together(rows, _model(), concurrency=3).collect()}
    assert found == {"a": (None, 1, True), "b": (None, 2, True), "c": (None, 3, True), "d": ("JSONDecodeError", 3, True), "e": ("NoPrompt", 0, False), "f": (None, 1, True)}
    two = {r["chunk_id"]: (r["error_type"], r["tries"]) for r in extraction.answered_together(rows, _model(), tries=2).collect()}
    assert two["c"] == ("TimeoutError", 2) and two["b"] == (None, 2)
    assert extraction.answered_together(rows.limit(0), _model()).count() == 0


def test_calls_run_together_up_to_the_limit(spark):
    def model(texts):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.05)
        with lock:
            state["now"] -= 1
        return [json.dumps({"most": state["most"]})]

    class Here:  # made in the worker: a lock is not sent
        def __call__(self, texts):
            global lock, state
            if "lock" not in globals():
                lock, state = threading.Lock(), {"now": 0, "most": 0}
            return model(texts)

    rows = spark.range(24).selectExpr("id", "cast(id as string) as prompt").coalesce(1)
    most = max(json.loads(r["answer"])["most"] for r in extraction.answered_together(rows, Here(), concurrency=4).collect())
    assert 1 < most <= 4


def test_a_run_resumes_where_the_last_one_failed(spark, tmp_path):
    folder = str(tmp_path / "runs")
    rows = spark.createDataFrame([(i, ["s1"], p) for i, p in PROMPTS if p], "chunk_id string, section_keys array<string>, prompt string").coalesce(1)
    first = extraction.extraction_run(rows, _model(), folder, tries=2).first()
    assert (first["chunks"], first["completed"], first["failed"], first["skipped"], first["calls"], first["accepted_cases"]) == (4, 2, 2, 0, 7, 2)
    assert sorted((r["chunk_id"], r["error_type"]) for r in spark.read.parquet(f"{folder}/errors").collect()) == [("c", "TimeoutError"), ("d", "JSONDecodeError")]
    second = extraction.extraction_run(rows, _model(), folder, tries=3).first()
    assert (second["run"], second["completed"], second["failed"], second["skipped"], second["accepted_cases"]) == (1, 1, 1, 2, 1)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(f"{folder}/cases").collect()) == ["a", "b", "c"]
    assert {tuple(r["section_keys"]) for r in spark.read.parquet(f"{folder}/cases").collect()} == {("s1",)}
    assert spark.read.parquet(f"{folder}/summary").count() == 2


def test_a_worker_holds_few_answers_at_once(spark):
    def model(texts):
        with open("/proc/self/statm") as held:
            return [f"{int(held.read().split()[1]) * 4096 >> 20} " + "x" * 500_000]

    rows = spark.range(0, 800, 1, 1).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    told = [int(r["mb"]) for r in extraction.answered(rows, model).select("error", F.split("answer", " ")[0].alias("mb")).collect()]
    assert len(told) == 800 and max(told) - min(told) < 200
