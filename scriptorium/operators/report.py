"""Report parts composed from ranked cases: recommendation, mirrors, citations, checks, diagram, markdown. One projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import first_filled, shortened, text_or_empty


def mirrors(hits: DataFrame, base: float = 0.45, most: float = 0.95) -> DataFrame:
    """hits with confidence = min(most, base + score / 3)."""
    return hits.withColumn("confidence", F.round(F.least(F.lit(most), base + F.col("score") / 3), 6))


def citations(evidence: DataFrame, titles: DataFrame, member: str = "member", query: str = "query_id", direct: float = 0.55) -> DataFrame:
    """Evidence with the title of its chunk (empty if unknown), how it is used and a confidence; the first case of a chunk only."""
    first = evidence.withColumn("__n", F.row_number().over(Window.partitionBy(query, member).orderBy("place"))).where("__n = 1").drop("__n")
    use = F.when(F.col("score") >= direct, "direct").otherwise("background")
    return first.join(titles, member, "left").withColumns({"title": F.coalesce("title", F.lit("")), "usage": use, "confidence": F.round(F.least(F.lit(0.92), 0.48 + F.col("score")), 6)})


def recommendation(scene: Column, cases: Column, by_scene: dict[str, str], default: str) -> Column:
    """From the first case where there is any, else by scene."""
    out = F.lit(None).cast("string")
    for name, text in by_scene.items():
        out = F.when(scene == name, text).otherwise(out)
    return F.when(F.size(cases) > 0, first_filled(F.get(cases, F.lit(0))["focus"], F.get(cases, F.lit(0))["title"])).otherwise(F.coalesce(out, F.lit(default)))


def checks(evidence: Column, options: Column, diagram: Column) -> Column:
    """Notes on what is missing: evidence, two options, a safe diagram. Empty: passed."""
    return F.array_compact(F.array(F.when(F.size(evidence) == 0, F.lit("no evidence")), F.when(F.size(options) < 2, F.lit("fewer than two options")), F.when(~safe_diagram(diagram), F.lit("unsafe diagram"))))


def diagram(nodes: Column, edges: Column) -> Column:
    """A Mermaid flow chart. nodes: array of names; edges: array of struct(a, b, label), numbers from 0."""
    clean = lambda c: F.regexp_replace(text_or_empty(c), r"[\[\]{}()<>|\"`]", "")
    boxes = F.transform(nodes, lambda n, i: F.concat(F.lit("  n"), i.cast("string"), F.lit("["), clean(n), F.lit("]")))
    arrows = F.transform(edges, lambda e: F.concat(F.lit("  n"), e["a"].cast("string"), F.lit(" -->|"), clean(e["label"]), F.lit("| n"), e["b"].cast("string")))
    return F.array_join(F.concat(F.array(F.lit("graph TD")), boxes, arrows), "\n")


def safe_diagram(text: Column) -> Column:
    return text.startswith("graph ") & ~text.rlike(r"(?i)<script|javascript:|click ") & text.contains("[")


def markdown_report(rows: DataFrame, title: str, question: str, judgement: str, advice: str, evidence: str) -> DataFrame:
    """rows with `markdown`: title, question, judgement, advice and the evidence as a list."""
    items = F.array_join(F.transform(F.col(evidence), lambda e: F.concat(F.lit("- "), shortened(e, 220))), "\n")
    parts = [F.lit("# " + title), F.concat(F.lit("> "), text_or_empty(F.col(question))), F.lit("## Judgement"), text_or_empty(F.col(judgement)), F.lit("## Advice"), text_or_empty(F.col(advice)), F.lit("## Evidence"), items]
    return rows.withColumn("markdown", F.concat_ws("\n\n", *parts))
