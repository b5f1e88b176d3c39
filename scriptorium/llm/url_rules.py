"""URL filters: rules on host and path, looked up by hash prefixes.

A url is expanded into expressions, every suffix of its host with every prefix of its path, as far as a rule could have them:
only host suffixes of as many labels, and path prefixes of as many characters, as occur among the rules. Each expression
meets the rules by an equality join on the first 32 bits of its SHA-256; what meets is confirmed by the whole digest. Of the
rules that fit, the longest (characters of host and path) wins, then the one with the longer host, then block before allow.

Scale. Only ids and urls are read. Up to BROADCAST_RULES rules go to all executors and nothing is shuffled but one short row a url, after
partial aggregation in the task that read it. Beyond that, rules that no url can meet are left out first (the distinct prefixes of
urls, aggregated before they are shuffled), and if many remain they meet the expressions by a shuffle on prefix and a salt, so
that a host which a third of all urls share is spread over SALTS tasks. Label and character counts come to the driver: one small number each.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; ports and user names are part of it. Path: from there up to
"?", "#" or the end. A rule fits its host and all its subdomains, if the path starts with the rule's path ("" fits every path).

Edge cases. Null urls and urls without "://" have an empty host and path. A rule with a null host or path counts as "". Equal rules
count once; if they disagree, block wins. A rule's verdict is allow or block. No rule fits: rule null, verdict `default`. Null ids and repeated
rows are judged one by one (a row is known by its place in its partition, so the input must be deterministic, as tables are). Very long urls
are expanded in as many places as rules ask for, no more. Empty table: no rows. No rules: everything gets the default. Columns of
the input other than id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rules that may be sent to all executors (some 50 MB).
BROADCAST_RULES = 200_000
SALTS = 32
PREFIX_HEX = 8


def host_and_path(url: Column) -> dict[str, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return {"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path}


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; where the host ends is part of it."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """digest, prefix, host, path, labels, rule, length, verdict: one row an expression."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    one = rules.select(text("host").alias("host"), text("path").alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is the greater
    full = one.withColumns({"digest": digest(F.col("host"), F.col("path")), "rule": F.concat("host", "path"), "labels": F.size(F.split("host", r"\.", -1))})
    return full.withColumns({"prefix": F.substring("digest", 1, PREFIX_HEX), "length": F.length("rule"), "host_length": F.length("host"), "path_length": F.length("path")})


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """urls (with __row, host and path) once for each expression, with its digest and prefix; and once without a digest, under a prefix that no rule has."""
    whole = F.size(F.split("host", r"\.", -1))
    hosts = F.filter(F.array(*[F.when(whole >= n, F.substring_index("host", ".", -n)) for n in labels]), lambda x: x.isNotNull())
    some = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    paths = F.transform(some, lambda n: F.substring(F.col("path"), F.lit(1), n))
    nothing = F.array(F.lit(None).cast("string"))
    by_host = urls.withColumn("__host", F.explode(F.concat(hosts, nothing)))
    both = by_host.withColumn("__path", F.explode(F.when(F.col("__host").isNull(), nothing).otherwise(paths)))
    named = both.withColumn("digest", digest(F.col("__host"), F.col("__path"))).drop("__host", "__path")
    return named.withColumn("prefix", F.coalesce(F.substring("digest", 1, PREFIX_HEX), F.concat(F.lit("-"), F.col("__row").cast("string"))))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The id column, host, path, rule and verdict of every row. rules: host, path, verdict (allow or block)."""
    known = durable(prepared(rules))
    urls = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).withColumns({"__row": F.monotonically_increasing_id(), **host_and_path(F.col("__url"))}).drop("__url")
    labels, lengths = (sorted(r[0] for r in known.select(c).distinct().collect()) for c in ("labels", "path_length"))
    none = urls.select(F.col("__id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not labels:
        return none
    asked = expressions(urls, labels, lengths)
    if known.count() > BROADCAST_RULES:
        known = durable(known.join(asked.where("digest is not null").select("prefix").distinct(), "prefix", "left_semi"))
    slim = known.select("prefix", F.col("digest").alias("rule_digest"), "length", "host_length", F.col("verdict").alias("rule_verdict"), "rule")
    if known.count() <= BROADCAST_RULES:
        met = asked.join(F.broadcast(slim), "prefix", "left")
    else:
        spread = slim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int")).join(spread, ["prefix", "__salt"], "left")
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct("length", "host_length", "rule_verdict", "rule"))
    best = met.groupBy("__row", "__id", "host", "path").agg(F.max(fits).alias("answer"))
    return best.select(F.col("__id").alias(id_col), "host", "path", F.col("answer.rule").alias("rule"), F.coalesce("answer.rule_verdict", F.lit(default)).alias("verdict"))
