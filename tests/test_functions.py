"""Scalar, token and similarity functions on literal rows."""

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import tokens as T


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    cjk = lambda s: set(one(spark, T.tokens(F.col("t"), T.CJK_TOKEN), t=s))
    assert cjk("甲乙丙") == {"甲乙丙", "甲乙", "乙丙"}
    assert cjk("甲乙丙丁戊己庚辛壬癸子丑寅") == {"甲乙丙丁戊己庚辛壬癸子丑寅"}
    assert cjk("甲 Ab_1") == {"Ab_1"}
    assert "老板" in one(spark, T.tokens(F.col("t"), T.CJK_TOKEN, ["老板"]), t="老 板 x")
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_bigrams_and_jaccard(spark):
    assert one(spark, T.bigrams(F.col("t")), t="ab") == ["ab"]
    assert one(spark, T.bigrams(F.col("t")), t="") == []
    assert one(spark, T.bigrams(F.col("t")), t="abab") == ["ab", "ba"]
    assert one(spark, T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_query_terms(spark):
    found = one(spark, T.query_terms(F.col("t"), ["是谁", "杀了"], cjk=True), t="谁杀了侠累甲乙丙 Ab x")
    assert "ab" in one(spark, T.query_terms(F.col("t"), cjk=True, dense=False), t="侠累 Ab x")
    assert "侠累" in found and "侠累甲乙" in found and "侠累甲乙丙" not in found
    assert one(spark, T.clean_terms(F.array(F.lit("bb"), F.lit("A"), F.lit("ccc"), F.lit("bb"), F.lit("no")), ["no"])) == ["ccc", "bb", "a"]


def test_text(spark):
    assert one(spark, X.normalized(F.col("t"), ["<B"]), t="﻿　a <b>b</b>  c ") == "a b c"
    assert one(spark, X.comparable(F.col("t")), t="Naïve, über_1!") == "naïveüber_1"
    assert one(spark, X.shortened(F.col("t"), 10), t="x" * 11) == "x" * 7 + "..."
    assert one(spark, X.safe_double(F.col("t")), t="n/a") == 0.0 and one(spark, X.safe_int(F.col("t")), t="3.7") == 3
    assert one(spark, X.slug(F.col("t")), t=" A b--c! ") == "A-b-c"
    assert one(spark, X.first_filled(F.lit(None).cast("string"), F.lit(" "), F.lit("b"))) == "b"
    assert one(spark, X.unique_filled(F.array(F.lit(" a"), F.lit("b"), F.lit("a "), F.lit("")))) == ["a", "b"]
    assert one(spark, X.numbered("m", F.lit(7))) == "m00007"
    assert one(spark, X.occurrences(F.col("t"), "aa"), t="aaaaa") == 2
    assert one(spark, X.sentences(F.col("t"), X.CJK_SENTENCE), t="甲。乙！丙") == ["甲。", "乙！", "丙"]
    assert one(spark, X.filled_template(F.lit("a {{x}}"), {"x": F.lit("b")})) == "a b"
    assert one(spark, X.html_escaped(F.lit("<a&'\">"))) == "&lt;a&amp;&#x27;&quot;&gt;"
    assert one(spark, T.distance_score(F.lit(1.5))) == 0.0
