"""Structured records from chunks by an external model: prompts, calls, robust parsing, normalising.

The model is a function from a list of prompts to a list of answers that runs in the workers; there is no network here, so
tests pass a deterministic one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.functions.text import filled_template, numbered, safe_double, slug, text_or_empty, unique_filled

CASE = "struct<title:string,summary:string,case_type:string,score:string,section_keys:array<string>,actors:array<struct<name:string,role:string,stance:string>>>"
#: Answers that a worker holds at once.
ANSWERS = 64
ANSWER = f"struct<cases:array<{CASE}>,global_notes:array<string>>"


def payload(chunk_columns: list[str]) -> Column:
    return F.to_json(F.struct(*chunk_columns))


def section_texts(keys: Column, text: Column) -> Column:
    """Map section -> text: line by line where the numbers agree, the whole text for a single section, else empty."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(F.size(keys) == F.size(lines), F.map_from_arrays(keys, lines)).when(F.size(keys) == 1, F.map_from_arrays(keys, F.array(text))).otherwise(none)


def prompts(chunks: DataFrame, template: str, values: dict[str, Column], name: str = "prompt") -> DataFrame:
    return chunks.withColumn(name, filled_template(F.lit(template), values))


def answered(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """rows with `answer` and `error`: a failing call is tried again, then its error is kept and the answer is null. A worker holds ANSWERS answers at once."""

    fresh = rows.drop("answer", "error")

    def run(batches):
        import pyarrow as pa

        def call(text: str | None) -> tuple[str | None, str | None]:
            error = None
            for _ in range(retries + 1):
                try:
                    return model([text])[0], None
                except Exception as e:  # noqa: BLE001  whatever a client raises is data here
                    error = f"{type(e).__name__}: {e}"
            return None, error

        for batch in batches:
            for at in range(0, batch.num_rows, ANSWERS):
                part = batch.slice(at, ANSWERS)
                told = [call(text.as_py()) for text in part.column(batch.schema.get_field_index(prompt))]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([t[i] for t in told], pa.string()) for i in range(2))], names=[*part.schema.names, "answer", "error"])

    return fresh.mapInArrow(run, StructType([*fresh.schema.fields, *StructType.fromDDL("answer string, error string").fields]))


def parsed_object(answer: str) -> dict:
    """The JSON object in an answer, as json_text finds it; raises where there is none."""
    import json
    import re

    bare = re.sub(r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "", answer or "").strip(" ")
    inner = bare if bare.startswith("{") and bare.endswith("}") else (re.search(r"(?s)\{.*\}", bare) or [""])[0]
    found = json.loads(inner)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def answered_together(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", tries: int = 3, concurrency: int = 4, check: Callable[[str], object] = parsed_object) -> DataFrame:
    """rows with answer, error_type, error and tries: a task asks the model for up to `concurrency` rows at once, and again, up to `tries` times in all, for those alone whose call
    failed or whose answer check() does not accept. The last answer is kept with its error.

    model is called from several threads. A null prompt is not asked: answer null, tries 0, error_type NoPrompt. A task works through its rows in windows, so few answers are in memory.
    """
    kinds = rows.schema

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        def ask(text: str) -> tuple[str | None, str | None, str | None]:
            answer = None
            try:
                answer = model([text])[0]
                check(answer)
            except Exception as e:  # noqa: BLE001  whatever a client or its answer raises is data here
                return answer, type(e).__name__, str(e)
            return answer, None, None

        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(prompt)).to_pylist()
                for at in range(0, len(texts), 16 * concurrency):
                    part = texts[at : at + 16 * concurrency]
                    found = [(None, "NoPrompt", "no prompt")] * len(part)
                    times = [0] * len(part)
                    left = [i for i, text in enumerate(part) if text is not None]
                    for _ in range(tries):
                        for i, told in zip(left, pool.map(ask, [part[i] for i in left])):
                            found[i], times[i] = told, times[i] + 1
                        left = [i for i in left if found[i][1] is not None]
                    window = batch.slice(at, len(part))
                    more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array(times, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*window.columns, *more], names=[*window.schema.names, "answer", "error_type", "error", "tries"])

    fresh = rows.drop("answer", "error_type", "error", "tries")
    return fresh.mapInArrow(run, StructType([*[f for f in kinds.fields if f.name not in ("answer", "error_type", "error", "tries")], *StructType.fromDDL("answer string, error_type string, error string, tries int").fields]))


def extraction_run(asked: DataFrame, model: Callable[[list[str]], list[str]], folder: str, chunk: str = "chunk_id", tries: int = 3, concurrency: int = 4) -> DataFrame:
    """One run over the chunks that no earlier run in `folder` finished: answers, accepted cases, errors and a summary, each appended to a table there. Returns the summary row.

    Tables: answers (chunk, answer, tries), cases, errors (chunk, error_type, error, tries, run), summary. A chunk is finished when its answer parsed; one that failed is asked again by the next
    run. Answers are written first, so a run that is broken off costs nothing that was paid for: the next one takes up the rest, and cases are made from written answers.
    """
    spark = asked.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    held = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda name: held.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS"))
    done = spark.read.parquet(f"{folder}/answers").where("error_type is null").select(chunk) if there("answers") else None
    number = spark.read.parquet(f"{folder}/summary").count() if there("summary") else 0
    pending = asked if done is None else asked.join(done.distinct(), chunk, "left_anti")
    told = answered_together(pending, model, tries=tries, concurrency=concurrency).withColumn("run", F.lit(number))
    told.select(*[c for c in told.columns if c != "prompt"]).write.mode("append").parquet(f"{folder}/answers")
    own = spark.read.parquet(f"{folder}/answers").where(F.col("run") == number)
    own.where("error_type is not null").select(chunk, "error_type", "error", "tries", "run").write.mode("append").parquet(f"{folder}/errors")
    made = cases(own.where("error_type is null"), chunk).withColumn("run", F.lit(number))
    made.write.mode("append").parquet(f"{folder}/cases")
    kept = spark.read.parquet(f"{folder}/cases").where(F.col("run") == number).agg(F.count("*").alias("accepted_cases"))
    counts = own.agg(F.count(F.when(F.col("error_type").isNull(), 1)).alias("completed"), F.count("error_type").alias("failed"), F.coalesce(F.sum("tries"), F.lit(0)).alias("calls"))
    total = asked.agg(F.count("*").alias("chunks"))
    row = total.crossJoin(counts).crossJoin(kept).select(F.lit(number).alias("run"), "chunks", (F.col("chunks") - F.col("completed") - F.col("failed")).alias("skipped"), "completed", "failed", "calls", "accepted_cases")
    row.write.mode("append").parquet(f"{folder}/summary")
    return spark.read.parquet(f"{folder}/summary").where(F.col("run") == number)


def json_text(answer: Column) -> Column:
    """The JSON object in an answer: fences and prose around it dropped."""
    bare = F.trim(F.regexp_replace(text_or_empty(answer), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(bare.startswith("{") & bare.endswith("}"), bare).otherwise(F.regexp_extract(bare, r"(?s)\{.*\}", 0))


def cases(rows: DataFrame, chunk: str = "chunk_id", answer: str = "answer", least: float = 0.65, priority: float = 0.85) -> DataFrame:
    """One row per accepted case of the answers: id, fields, section keys that the chunk has (all of the chunk's if none)."""
    parsed = rows.withColumn("__p", F.from_json(json_text(F.col(answer)), ANSWER)).select(chunk, "section_keys", F.posexplode("__p.cases").alias("n", "c"))
    kept = F.array_intersect(F.coalesce(F.col("c.section_keys"), F.array().cast("array<string>")), F.col("section_keys"))
    title = F.trim(F.coalesce("c.title", F.lit("")))
    return parsed.withColumn("score", safe_double(F.col("c.score"))).where(F.col("score") >= least).select(
        F.concat(F.lit("case-"), F.col(chunk), numbered("-", F.col("n") + 1, 2), F.lit("-"), slug(title)).alias("case_id"), chunk, title.alias("title"), F.trim(F.coalesce("c.summary", F.lit(""))).alias("summary"),
        F.coalesce(F.nullif(F.col("c.case_type"), F.lit("")), F.lit("other")).alias("case_type"), "score", F.lit(priority).alias("source_priority"),
        F.when(F.size(kept) > 0, kept).otherwise(F.col("section_keys")).alias("section_keys"), F.filter(F.coalesce("c.actors", F.array().cast("array<struct<name:string,role:string,stance:string>>")), lambda a: F.trim(a["name"]) != "").alias("actors"),
    )


def chunk_outcomes(rows: DataFrame, accepted: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """chunk, cases_returned, cases_accepted, global_notes and ok."""
    parsed = rows.withColumn("__p", F.from_json(json_text(F.col("answer")), ANSWER))
    counts = accepted.groupBy(chunk).agg(F.count("*").alias("cases_accepted"))
    out = parsed.select(chunk, F.greatest(F.coalesce(F.size("__p.cases"), F.lit(0)), F.lit(0)).alias("cases_returned"), F.coalesce(unique_filled(F.col("__p.global_notes")), F.array().cast("array<string>")).alias("global_notes"), F.col("__p").isNotNull().alias("ok"))
    return out.join(counts, chunk, "left").withColumn("cases_accepted", F.coalesce("cases_accepted", F.lit(0)))


def question_rows(cases: DataFrame, model: Callable[[list[str]], list[str]], template: str, n: int = 300, seed: int = 42, case: str = "case_id") -> DataFrame:
    """query, expected_id, expected_title, case_type: questions that a model asks about a sample of cases (case, title, summary, case_type), each of its
    lines one; cases for which the model fails give none."""
    from .audit import sampled

    asked = prompts(sampled(cases, case, n, seed), template, {"title": F.col("title"), "summary": F.col("summary")})
    lines = F.filter(F.transform(F.split(text_or_empty(F.col("answer")), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*]|\d+[.、)])\s*", ""))), lambda s: s != "")
    return answered(asked, model).select(F.explode(lines).alias("query"), F.col(case).alias("expected_id"), F.col("title").alias("expected_title"), "case_type")
