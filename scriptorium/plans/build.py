"""The corpus build as jobs: volume files to sections, sections to chunks and commentaries, chunks to window experiments, all to files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import CJK_SENTENCE, numbered, sentences
from scriptorium.operators import chunking, ordering, sections
from scriptorium.sources import files

HARD = 1600
#: Priorities of chunks whose sections are all paired, and of others.
PAIRED, UNPAIRED = 0.9, 0.84


def volume_sections(spark: SparkSession, folder: str, originals: DataFrame | None = None, charset: str = "GB18030") -> DataFrame:
    """Sections of all volume files below a folder. originals: volume, text of the whole-book paragraphs (sections.original_paragraphs)."""
    known = None if originals is None else originals.select(F.col("volume").cast("int").alias("volume_no"), "text")
    return sections.volume_sections(files.text_volumes(spark, folder, charset), known)


def chunks(of: DataFrame, version: str, prefix: str = "chunk", overlap: bool = True, sentence: str = CJK_SENTENCE, overlapping_parts: bool = False) -> DataFrame:
    """Chunks of sections (volume_no, section_key, chapter_title, year_title, white_text, pair_type), packed per run of one chapter.

    Sections without modern text are left out. A section longer than HARD is a chunk of its own in numbered parts, with sentences repeated
    from part to part if overlapping_parts. Chunks are numbered per volume; the parts of one section share a number.
    """
    rows = of.where("white_text <> ''").withColumn("place", F.substring_index("section_key", "-s", -1).cast("int"))
    rows = ordering.run_numbers(rows, ["volume_no"], "place", ["chapter_title"])
    lists = chunking.ordered_list(rows, ["volume_no", "run"], "place", "section_key", "chapter_title", "year_title", "white_text", "pair_type")
    packs = lists.select("volume_no", "run", "pieces", F.posexplode(chunking.overlapping_packs(F.transform("pieces", lambda p: F.length(p["white_text"])), overlap=overlap)).alias("n", "pack"))
    packs = ordering_in_volume(packs.withColumn("p", F.slice("pieces", F.col("pack.first"), F.col("pack.last") - F.col("pack.first") + 1)).drop("pieces"))
    of_piece = lambda name: F.transform("p", lambda x: x[name])
    text = F.array_join(of_piece("white_text"), "\n")
    long = (F.size("p") == 1) & (F.col("pack.size") > HARD)
    split = chunking.overlapping_sentence_parts if overlapping_parts else chunking.sentence_parts
    parts = F.when(long, F.transform(F.array(text), lambda t: split(sentences(t, sentence), t))[0]).otherwise(F.array(text))
    cut = packs.withColumn("long", long).select("*", F.posexplode(parts).alias("part", "white_text"))
    name = F.concat(F.lit(f"{prefix}-v"), F.lpad(F.col("volume_no").cast("string"), 3, "0"), numbered("-c", F.col("number")), F.when(F.col("long"), numbered("-p", F.col("part") + 1, 2)).otherwise(""))
    all_paired = F.forall("p", lambda x: x["pair_type"] == "paired")
    return cut.select(
        name.alias("chunk_id"), "volume_no", F.get("p", F.lit(0))["chapter_title"].alias("chapter_title"), chunking.merged_titles(of_piece("year_title")).alias("year_title"), "white_text", F.length("white_text").alias("white_char_count"),
        of_piece("section_key").alias("section_keys"), F.size("p").alias("section_count"), chunking.histogram_text(of_piece("pair_type")).alias("pair_types"), F.when(all_paired, PAIRED).otherwise(UNPAIRED).alias("source_priority"), F.lit(version).alias("chunk_version"),
    )


def ordering_in_volume(packs: DataFrame) -> DataFrame:
    """packs (volume_no, run, n) with number, from 1 in order within a volume. One row a pack goes through the window, without texts."""
    keys = ["volume_no", "run", "n"]
    slim = packs.select(*keys).withColumn("number", F.row_number().over(Window.partitionBy("volume_no").orderBy("run", "n")))
    return packs.join(slim, keys)


def tagging_build(white: DataFrame, markers: list[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with their commentaries, commentaries with their chunks) of an export's sections (sections.marked_sections)."""
    facts, comments = sections.commentaries(white.withColumn("volume_no", F.substring("section_key", 1, 3).cast("int")), markers)
    made = chunks(facts.select("volume_no", "section_key", F.col("chapter").alias("chapter_title"), F.col("year").alias("year_title"), "white_text", F.lit("white_only").alias("pair_type")), version, "tagging", overlapping_parts=True)
    linked = chunking.links(comments, made.select("chunk_id", F.col("section_keys").alias("keys")), "section_key", "commentary_id")
    back = linked.select("commentary_id", F.explode("chunks").alias("chunk_id")).groupBy("chunk_id").agg(F.sort_array(F.collect_set("commentary_id")).alias("commentary_ids"))
    none = F.array().cast("array<string>")
    return made.join(back, "chunk_id", "left").withColumn("commentary_ids", F.coalesce("commentary_ids", none)), linked


def window_experiment(of: DataFrame, group: str, order: str, text: str, sizes: list[int], groups: list[object] | None = None) -> DataFrame:
    """group, mode, window (from 1), first, last, chars of windows of several sizes and over whole groups; only some groups if given."""
    rows = of if groups is None else of.where(F.col(group).isin(groups))
    lists = chunking.ordered_list(rows, [group], order, text)
    lengths = F.transform("pieces", lambda p: F.length(F.coalesce(p[text], F.lit(""))))
    made = [lists.select(group, F.lit(f"w{size}").alias("mode"), F.posexplode(chunking.sized_packs(lengths, size)).alias("n", "p")) for size in sizes]
    whole = F.struct(F.lit(1).alias("first"), F.size("pieces").alias("last"), F.aggregate(lengths, F.lit(0), lambda a, x: a + x).alias("size"))
    made.append(lists.select(group, F.lit("whole").alias("mode"), F.lit(0).alias("n"), whole.alias("p")))
    return reduce(lambda a, b: a.unionByName(b), made).select(group, "mode", (F.col("n") + 1).alias("window"), "p.first", "p.last", F.col("p.size").alias("chars"))


def white_only(of: DataFrame) -> DataFrame:
    """Sections that have no original, for an export of their own."""
    return of.where(F.col("pair_type") == "white_only").select("volume_no", "section_key", "chapter_title", "year_title", "white_text")


def write(spark: SparkSession, folder: str, target: str, version: str, originals: DataFrame | None = None, charset: str = "GB18030") -> DataFrame:
    """All volumes of a folder to sections and chunks, each a folder of JSON lines below target; returns one row of counts."""
    of = volume_sections(spark, folder, originals, charset)
    files.write_json(of, f"{target}/sections")
    of = spark.read.schema(of.schema).json(f"{target}/sections")
    made = chunks(of, version)
    files.write_json(made, f"{target}/chunks")
    made = spark.read.schema(made.schema).json(f"{target}/chunks")
    return of.agg(F.count("*").alias("sections"), F.countDistinct("volume_no").alias("volumes")).crossJoin(made.agg(F.count("*").alias("chunks"), F.sum("white_char_count").alias("chars")))
