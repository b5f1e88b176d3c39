"""Normalising records, exact and near-duplicate merging.

Exact groups merge by aggregation on a key. Near duplicates are compared only where they may merge: equal blocking columns and a
distance of at most `distance` in corpus order, which is an equality join on shifted ordinals and never all pairs of a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.functions import lexicon
from scriptorium.functions import tokens as T
from scriptorium.functions.text import comparable, contains_any, unique_filled
from scriptorium.sources.store import durable

UNKNOWN_ORDINAL = 10**9


def catalog(chunks: DataFrame, chunk: str = "chunk_id", keys: str = "section_keys", order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(chunk, ordinal) and (section, chunk ordinal, position); the last chunk that holds a section wins."""
    sections = chunks.select(order, F.posexplode(keys).alias("position", "section")).where(F.trim("section") != "")
    last = sections.groupBy(F.trim("section").alias("section")).agg(F.max(F.struct(order, "position")).alias("at"))
    return chunks.groupBy(chunk).agg(F.max(order).alias(order)), last.select("section", F.col(f"at.{order}").alias(order), "at.position")


def _first_rule(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule (condition, value) that holds."""
    held = F.array_compact(F.array(*[F.when(condition, value) for condition, value in rules])) if rules else F.array().cast("array<string>")
    return F.coalesce(F.get(held, F.lit(0)), otherwise)


def canonical_role(role: Column, exact: dict[str, str] | None = None, contains=lexicon.ROLE_CONTAINS, rules=lexicon.ROLE_RULES) -> Column:
    """The canonical name of a role: exact names, then rules on what it contains, else the role itself."""
    role = F.trim(F.coalesce(role, F.lit("")))
    exact = lexicon.ROLE_EXACT | {"决策者": "最高决策者/组织负责人"} if exact is None else exact
    table = [([name], [], [], len(name), to) for name, to in exact.items()] + list(contains) + [(list(needles), [], [], None, to) for needles, to in rules]
    every = lambda words: reduce(lambda a, b: a & b, [role.contains(w) for w in words], F.lit(True))
    held = [(every(all_of) & (contains_any(role, any_of) if any_of else F.lit(True)) & ~contains_any(role, none_of) & (F.length(role) <= (10**6 if most is None else most)), F.lit(to)) for all_of, any_of, none_of, most, to in table]
    return _first_rule(held, role)


def modern_role(role: Column, stance: Column, name: Column | None = None, markers=lexicon.ROLE_MARKERS, names=lexicon.ROLE_MAP, persons=lexicon.PERSON_ROLES, moves=lexicon.MOVED_ROLES) -> Column:
    """The modern name of an ancient role: roles that are modern stay, then rules on the person, then the first ancient name that the role
    contains; the role's or the stance's words may move that one."""
    role, stance, name = F.trim(F.coalesce(role, F.lit(""))), F.coalesce(stance, F.lit("")), F.lit("") if name is None else F.coalesce(name, F.lit(""))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in names])
    hit = F.get(F.filter(pairs, lambda x: F.contains(role, x["a"])), F.lit(0))["b"]
    told = lambda of_role, of_stance: contains_any(role, of_role) | contains_any(stance, of_stance)
    held = [((role == "") | contains_any(role, markers), role)]
    held += [((contains_any(name, who) | (contains_any(role, who) & F.lit(also_role))) & told(a, b), F.lit(to)) for who, also_role, a, b, to in persons]
    held += [((hit == of) & told(a, b), F.lit(to)) for of, a, b, to in moves]
    return _first_rule(held, F.coalesce(hit, role))


def normalized_records(rows: DataFrame, texts: list[str], lists: list[str], defaults: dict[str, object]) -> DataFrame:
    """Trimmed texts (null: empty), lists without blanks and repeats, and defaults for nulls."""
    changed = {c: F.trim(F.coalesce(c, F.lit(""))) for c in texts} | {c: F.coalesce(unique_filled(F.col(c)), F.array().cast("array<string>")) for c in lists}
    return rows.withColumns(changed | {c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def exact_groups(rows: DataFrame, key: list[Column], prefer: list[Column], keep: list[str], unite: list[str], largest: list[str]) -> DataFrame:
    """One row per key: `keep` of the preferred row (largest `prefer`), sorted union of `unite`, maxima of `largest`, and members."""
    named = [k.alias(f"key{i}") for i, k in enumerate(key)]
    best = F.max_by(F.struct(*keep), F.struct(*prefer)).alias("best")
    merged = rows.groupBy(*named).agg(best, *[F.sort_array(F.collect_set(c)).alias(c + "s") for c in unite], *[F.max(c).alias("max_" + c) for c in largest], F.count("*").alias("members"))
    return merged.select("best.*", *[c + "s" for c in unite], *["max_" + c for c in largest], "members")


def adjacent_near_duplicates(rows: DataFrame, order: str, text: str, block: list[str], distance: int = 5, threshold: float = 0.82) -> DataFrame:
    """a, b, similarity: rows of equal block, at most `distance` apart in order, with bigram similarity from the threshold on.

    A null ordinal is adjacent to nothing. A row is copied `distance` times, with its bigrams, whatever the size of its block.
    """
    ready = rows.where(F.col(order).isNotNull()).select(F.col(order).alias("o"), *block, T.bigrams(comparable(F.col(text))).alias("grams"))
    shifted = ready.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(distance)), lambda i: F.col("o") + i)).alias("o"), F.col("o").alias("a"), *[F.col(c).alias("_" + c) for c in block], F.col("grams").alias("grams_a"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("_" + c)) for c in block], F.lit(True))
    # Sets whose sizes differ too much cannot reach the threshold.
    sizes = (F.size("grams") >= threshold * F.size("grams_a")) & (F.size("grams_a") >= threshold * F.size("grams"))
    near = ready.join(shifted, "o").where(same & sizes).withColumn("similarity", T.jaccard(F.col("grams"), F.col("grams_a"))).where(F.col("similarity") >= threshold)
    return near.select("a", F.col("o").alias("b"), F.round("similarity", 6).alias("similarity"))


def merge_pairs(rows: DataFrame, order: str, section: str, grams: str, block: list[str], reach: int, near: float = 0.82, overlapping: float = 0.72) -> DataFrame:
    """a, b, overlap, similarity of the pairs that may merge: equal block, next to each other or of one section, similar enough.

    reach: how far apart in order rows of one section can be. Only ordinals and sections are copied; the arrays of grams meet for pairs that
    are close enough, as an equality join.
    """
    key = rows.select(F.col(order).alias("a"), F.col(section).alias("s"), *block)
    shifted = key.select("a", F.col("s").alias("s1"), *[F.col(c).alias("_" + c) for c in block], F.explode(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda i: F.col("a") + i)).alias("b"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("_" + c)) for c in block], F.lit(True))
    pairs = shifted.join(key.select(F.col("a").alias("b"), "s", *block), "b").where(same).withColumn("overlap", F.coalesce(F.col("s") == F.col("s1"), F.lit(False))).where("overlap or b = a + 1").select("a", "b", "overlap")
    left, right = (rows.select(F.col(order).alias(x), F.col(grams).alias("g" + x)) for x in "ab")
    told = pairs.join(left, "a").join(right, "b").withColumn("similarity", T.jaccard(F.col("ga"), F.col("gb")))
    return told.where((F.col("similarity") >= near) | (F.col("overlap") & (F.col("similarity") >= overlapping))).select("a", "b", "overlap", F.round("similarity", 6).alias("similarity"))


def _grams(text: str) -> set[str]:
    return {text} if 0 < len(text) <= 2 else {text[i : i + 2] for i in range(len(text) - 1)}


def _folded(rows: list[tuple], kept: list[tuple], look_back: int, threshold: float) -> tuple[list, list[tuple]]:
    """Into which ordinal each (ordinal, text) merges, given the (ordinal, text) rows kept before; and the last ones kept."""
    last = [(o, t, _grams(t)) for o, t in kept]
    into = []
    for o, t in rows:
        grams = _grams(t)
        near = lambda g: grams and g and min(len(grams), len(g)) >= threshold * max(len(grams), len(g)) and len(grams & g) / len(grams | g) >= threshold  # noqa: B023, E731
        found = next((k for k in reversed(last) if near(k[2])), None)
        into.append(o if found is None else found[0])
        if found is None:
            last = [*last, (o, t, grams)][-look_back:]
    return into, [(o, t) for o, t, _ in last]


def folded_near_duplicates(rows: DataFrame, group: str, order: str, text: str, look_back: int = 5, threshold: float = 0.82) -> DataFrame:
    """group, order, merged_into: each row of a group, in order, merges into the nearest of the last `look_back` kept rows that is
    similar enough, else it is kept (merged_into = order).

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks. The fold of a piece depends on what came before by the last
    `look_back` kept rows alone. Groups that lie in several partitions are folded in rounds: all their pieces at once, each with what the piece before it kept in
    the last round, until no piece hands on anything new. After n rounds the first n pieces are right; as a piece that keeps `look_back` rows of its own seldom passes on a
    change, few rounds do. Between rounds `look_back` rows a piece, at most two pieces a partition, come to the driver. Equal ordinals go by a digest of the text. Null groups and ordinals come first.
    """
    kinds = dict(rows.dtypes)
    keys = [F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), F.md5("t"), F.col("row")]
    slim = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), comparable(F.col(text)).alias("t"), F.monotonically_increasing_id().alias("row"))
    dealt = durable(slim.repartitionByRange(*keys).sortWithinPartitions(*keys).select("g", "o", "t", F.spark_partition_id().alias("part")))
    known = F.struct(F.col("g").isNotNull().alias("known"), "g")
    edges = sorted(dealt.groupBy("part").agg(F.min(known)["g"].alias("first"), F.max(known)["g"].alias("last")).collect())  # one short row a partition
    cut = {b["first"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}

    def pieces(batches):
        key, held = None, []
        for batch in batches:
            for g, o, t, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (part, g) != key:
                    yield key, held
                    held = []
                key = part, g
                held.append((o, t or ""))
        if held:
            yield key, held

    def last_kept(of: DataFrame, before: dict) -> dict:
        def run(batches):
            import pyarrow as pa

            for (part, g), held in pieces(batches):
                _, last = _folded(held, before.get((part, g), []), look_back, threshold)
                yield pa.RecordBatch.from_pylist([{"part": part, "g": g, "os": [o for o, _ in last], "ts": [t for _, t in last]}], pa.schema([("part", pa.int32()), ("g", of_group), ("os", pa.list_(of_order)), ("ts", pa.list_(pa.string()))]))

        of_group, of_order = (to_arrow_type(of.schema[c].dataType) for c in "go")
        return {(r["part"], r["g"]): list(zip(r["os"], r["ts"])) for r in of.mapInArrow(run, f"part int, g {kinds[group]}, os array<{kinds[order]}>, ts array<string>").collect()}

    before: dict = {}
    if cut:
        spark = rows.sparkSession
        named = F.broadcast(spark.createDataFrame([(g,) for g in cut], f"__g {kinds[group]}"))  # fewer than partitions
        own = dealt.join(named, F.col("g").eqNullSafe(F.col("__g")), "left_semi")
        after = last_kept(own, {})
        following = {p: n for g in cut for parts in [sorted(p for p, h in after if h == g)] for p, n in zip([(x, g) for x in parts], [(x, g) for x in parts[1:]])}
        while True:
            changed = {n for p, n in following.items() if before.get(n, []) != after[p]}
            if not changed:
                break
            before |= {n: after[p] for p, n in following.items() if n in changed}
            some = F.broadcast(spark.createDataFrame(list(changed), f"__part int, __g {kinds[group]}"))
            after |= last_kept(own.join(some, (F.col("part") == F.col("__part")) & F.col("g").eqNullSafe(F.col("__g")), "left_semi"), before)

    def fold(batches):
        import pyarrow as pa

        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, types)], names=[group, order, "merged_into"])
        for (part, g), held in pieces(batches):
            into, _ = _folded(held, before.get((part, g), []), look_back, threshold)
            out += [(g, o, x) for (o, _), x in zip(held, into)]
            if len(out) >= 10_000:
                yield made()
                out = []
        yield made()

    types = tuple(to_arrow_type(dealt.schema[c].dataType) for c in "goo")
    return dealt.mapInArrow(fold, f"{group} {kinds[group]}, {order} {kinds[order]}, merged_into {kinds[order]}")


def merged_actors(rows: DataFrame, key: str, name: str = "name", role: str = "role", order: str = "position", most: int = 5) -> DataFrame:
    """key, name, role, place: one row per name with its longest role (the first of equal ones), in order of first mention, `most` a key."""
    one = rows.where(F.trim(name) != "").groupBy(key, F.trim(name).alias("name")).agg(F.max_by(F.col(role), F.struct(F.length(role), -F.col(order))).alias("role"), F.min(order).alias("first"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first", "name"))).where(F.col("place") <= most).drop("first")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def collapsed(rows: DataFrame, key: str, counts: list[str], notes: str) -> DataFrame:
    """One row per key: maxima of counts and the distinct notes in order."""
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in counts], F.sort_array(F.collect_set(notes)).alias(notes))


def consolidated(runs: list[DataFrame]) -> DataFrame:
    """Rows of several runs, columns matched by name; what a run lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
