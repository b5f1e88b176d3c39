"""From lines to sections: classification of lines, headings carried forward, numbered sections, commentary, HTML elements.

Lines are rows with a document and an ordinal. Headings and section numbers are carried by windows over one document each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import lexicon
from scriptorium.functions.text import CJK_SENTENCE, SPACE, contains_any, normalized, numbered, text_or_empty

from .tagging import modern_score, translation_like

NUMBERED = r"^\[(\d+)\]\s*(.*)$"
#: Forms of the headings of a volume text.
VOLUME, PREAMBLE, YEAR = r"^(?:资治通鉴)?第?[一二三四五六七八九十百零〇两\d]+卷|^卷第?[一二三四五六七八九十百零〇两\d]+", r"^【.*】$", r"^.{1,30}年（.*(?:前|公元).*）$"


def lines_of(rows: DataFrame, doc: str, text: str, keep_blank: bool = False) -> DataFrame:
    """doc, line (from 0), text: the lines of each text, trimmed, blank ones left out."""
    cut = rows.select(doc, F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    return cut if keep_blank else cut.where("text <> ''")


def is_noise(line: Column) -> Column:
    """Blank lines, watermarks, separators."""
    return (F.trim(line) == "") | line.rlike(r"(?i)^www\.") | line.rlike(r"^[-—─\s]{20,}$")


def split_numbered(text: Column) -> Column:
    """A paragraph cut before every [n] within it."""
    return F.filter(F.transform(F.split(text, r"(?<!^)(?=\[\d+\])"), lambda p: F.trim(p)), lambda p: p != "")


def number_and_body(text: Column) -> Column:
    """struct(number, body): number null unless the text starts with [n], 0 < n < 1000."""
    n = F.regexp_extract(text, NUMBERED, 1).try_cast("int")
    good = n.between(1, 999)
    return F.struct(F.when(good, n).alias("number"), F.when(good, F.trim(F.regexp_extract(text, NUMBERED, 2))).otherwise(text).alias("body"))


def line_kind(text: Column) -> Column:
    """content, volume, preamble, chapter or year, by ordered rules."""
    era = contains_any(text, ["前", "公元"])
    ruler = (F.length(text) <= 40) & contains_any(text, ["皇帝", "帝", "王"]) & contains_any(text, ["（", "("]) & era
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return (
        F.when(text.rlike(NUMBERED), "content").when(text.rlike(VOLUME), "volume").when(text.rlike(PREAMBLE), "preamble")
        .when((text.contains("纪") & text.contains("（") & (era | text.contains("元年"))) | ruler | ((count("纪") >= 2) & (count("（") >= 2)), "chapter").when(text.rlike(YEAR), "year").otherwise("content")
    )


def carried(rows: DataFrame, doc: str, order: str | list[str], kind: Column, text: str, levels: list[str], reset: bool = True) -> DataFrame:
    """rows with one column per heading level, outermost first: the text of the last heading of that level; if reset, empty again after a
    heading further out."""
    rows = rows.withColumn("__kind", kind)
    order = [order] if isinstance(order, str) else order
    ahead = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for i, level in enumerate(levels):
        outer = F.col("__kind").isin(levels[:i]) if i and reset else F.lit(False)
        value = F.when(F.col("__kind") == level, F.col(text)).when(outer, F.lit(""))
        rows = rows.withColumn(level, F.coalesce(F.last(value, ignorenulls=True).over(ahead), F.lit("")))
    return rows.drop("__kind")


def is_modern(text: Column, bonuses=lexicon.MODERN_BONUSES, short: int = lexicon.MODERN_SHORT) -> Column:
    """More marks of modern than of classical prose, with what the forms of a text add."""
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    forms = {
        "start": lambda words: any_of([text.startswith(w) for w in words]), "within": lambda words: contains_any(text, words), "match": lambda patterns: any_of([text.rlike(p) for p in patterns]),
        "short": lambda words: (F.length(text) <= short) & contains_any(text, words),
    }
    return reduce(lambda score, b: score + F.when(forms[b[0]](b[1]), b[2]).otherwise(0), bonuses, modern_score(text)) > 0


_NUMBERED_TEXT = "struct<number:int,volume:string,chapter:string,year:string,line:int,original:array<string>,modern:array<string>,last:string>"


def parted(paragraphs: Column, originals: Column, rules=lexicon.PARAGRAPH_RULES) -> Column:
    """Array of sections (number, titles, line, original, modern): the paragraphs of a stretch, each decided in the context of the ones before.

    paragraphs: array of struct(line, number, text, modern, known, soft, volume, chapter, year); modern is is_modern, known says that the text
    is among the originals, soft that a heading stands before it that only repeats a title: there a section ends unless it still lacks
    its modern text. originals: whether original paragraphs of the volume are known. The rules are a table, tried in order.
    """
    none = F.array().cast("array<string>")

    def decided(s: Column, p: Column) -> Column:
        holds = F.when((F.size(s["original"]) == 0) & (F.size(s["modern"]) == 0), "nothing").when(F.size(s["modern"]) == 0, "originals").otherwise("both")
        extra = {
            "known": p["known"], "originals": originals, "classical": p["text"].startswith(lexicon.CLASSICAL_OPENING), "modern opening": p["text"].startswith(lexicon.MODERN_OPENING),
            "long": p["modern"] | (F.length(p["text"]) > lexicon.LONG_PARAGRAPH),
        }
        outcome = {"original": F.lit(False), "modern": F.lit(True), "guess": p["modern"]}
        found = []
        for section, paragraph, held, last, condition, result in rules:
            tests = [F.lit(True)]
            tests += [] if section is None else [s["number"].isNotNull() == F.lit(section)]
            tests += [] if paragraph is None else [p["number"].isNotNull() == F.lit(paragraph)]
            tests += [] if held is None else [holds == held]
            tests += [] if last is None else [s["last"].eqNullSafe(F.lit(last))]
            tests += [] if condition is None else [extra[condition]]
            found.append(F.when(reduce(lambda a, b: a & b, tests), outcome[result]))
        return F.get(F.array_compact(F.array(*found)), F.lit(0))

    def added(s: Column, p: Column) -> Column:
        put = lambda modern: F.struct(
            *[s[c].alias(c) for c in ("number", "volume", "chapter", "year", "line")], F.when(modern, s["original"]).otherwise(F.concat(s["original"], F.array(p["text"]))).alias("original"),
            F.when(modern, F.concat(s["modern"], F.array(p["text"]))).otherwise(s["modern"]).alias("modern"), F.when(modern, "modern").otherwise("original").alias("last"),
        ).cast(_NUMBERED_TEXT)
        return F.get(F.transform(F.array(decided(s, p)), put), F.lit(0))

    def fresh(p: Column) -> Column:
        return F.struct(p["number"].alias("number"), *[p[c].alias(c) for c in ("volume", "chapter", "year", "line")], none.alias("original"), none.alias("modern"), F.lit(None).cast("string").alias("last")).cast(_NUMBERED_TEXT)

    def step(done: Column, p: Column) -> Column:
        n = F.size(done)
        current = F.get(done, n - 1)
        lacks_modern = (F.size(current["original"]) > 0) & (F.size(current["modern"]) == 0)
        goes_on = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(added(current, p)))
        return F.when((n == 0) | (p["soft"] & ~lacks_modern), F.concat(done, F.array(added(fresh(p), p)))).otherwise(goes_on)

    return F.aggregate(paragraphs, F.array().cast(f"array<{_NUMBERED_TEXT}>"), step)


def recovered_pairs(parts: Column) -> Column:
    """struct(original, modern) from modern parts only: a part followed by its translation is the original of it."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("original"), empty.alias("modern"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, p: Column) -> Column:
        pair = s["held"].isNotNull() & translation_like(p) & ~translation_like(s["held"])
        lone = F.when(s["held"].isNull(), s["modern"]).otherwise(F.concat(s["modern"], F.array(s["held"])))
        return F.when(pair, F.struct(F.concat(s["original"], F.array(s["held"])).alias("original"), F.concat(s["modern"], F.array(p)).alias("modern"), F.lit(None).cast("string").alias("held"))).otherwise(
            F.struct(s["original"].alias("original"), lone.alias("modern"), p.alias("held"))
        )

    end = lambda s: F.struct(s["original"].alias("original"), F.when(s["held"].isNull(), s["modern"]).otherwise(F.concat(s["modern"], F.array(s["held"]))).alias("modern"))
    return F.aggregate(parts, start, step, end)


def volume_sections(lines: DataFrame, originals: DataFrame | None = None, volume: str = "volume_no", order: str = "line", text: str = "text") -> DataFrame:
    """Sections of volume texts. lines: volume, order, text. originals: volume, text of the known original paragraphs.

    Paragraphs are cut at [n] marks, and where an original and its translation stand in one. A section opens at a new number, or at unnumbered
    text behind a heading, and closes at headings; a chapter or year heading that only repeats the head of the title before closes no
    section that still lacks its modern text. Result: volume_no, section_key, section_index, volume_title, chapter_title, year_title,
    original_text, white_text, pair_type. The lines of one volume meet in windows; those of one stretch between headings in one row.
    """
    rows = lines.select(F.col(volume).alias("volume_no"), F.col(order).alias("line"), F.posexplode(split_numbered(normalized(F.col(text)))).alias("place", "text")).where(~is_noise(F.col("text")))
    if originals is not None:
        known = originals.select(F.col(volume).alias("volume_no"), F.col("text"), F.lit(True).alias("known")).distinct()
        rows = _with_inline_pairs(rows, known)
        there = known.select("volume_no", F.lit(True).alias("originals")).distinct()
        rows = rows.join(known, ["volume_no", "text"], "left").join(there, "volume_no", "left")
    else:
        rows = rows.withColumns({"known": F.lit(None).cast("boolean"), "originals": F.lit(None).cast("boolean"), "half": F.lit(0)})
    rows = rows.withColumns({"kind": line_kind(F.col("text")), "nb": number_and_body(F.col("text")), "known": F.coalesce("known", F.lit(False)), "originals": F.coalesce("originals", F.lit(False))})
    at = ["line", "place", "half"]
    rows = carried(rows, "volume_no", at, F.col("kind"), "text", ["volume", "chapter", "year"], reset=False)
    w = Window.partitionBy("volume_no").orderBy(*at)
    head = lambda c: F.trim(F.substring_index(c, "（", 1))
    repeats = [(F.col("kind") == level) & (F.lag(level).over(w) != "") & (head(F.lag(level).over(w)) != "") & (head(F.lag(level).over(w)) == head(F.col("text"))) for level in ("chapter", "year")]
    rows = rows.withColumn("repeats", F.coalesce(repeats[0] | repeats[1], F.lit(False)))
    rows = rows.withColumns({"block": F.sum(((F.col("kind") != "content") & ~F.col("repeats")).cast("int")).over(w), "headings": F.sum(F.col("repeats").cast("int")).over(w)}).where("kind = 'content'")
    b = Window.partitionBy("volume_no", "block").orderBy(*at)
    before = F.last("nb.number", ignorenulls=True).over(b.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.row_number().over(b) == 1) | (F.col("nb.number").isNotNull() & ~F.col("nb.number").eqNullSafe(before))
    rows = rows.withColumns({"stretch": F.sum(opens.cast("int")).over(b), "soft": F.coalesce(F.col("headings") > F.lag("headings").over(b), F.lit(False))})
    piece = F.struct(*at, F.col("nb.number").alias("number"), F.col("nb.body").alias("text"), is_modern(F.col("nb.body")).alias("modern"), "known", "soft", "volume", "chapter", "year")
    found = rows.groupBy("volume_no", "block", "stretch", "originals").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    found = found.select("volume_no", "block", "stretch", F.posexplode(parted(F.col("pieces"), F.col("originals"))).alias("part", "p"))
    found = found.withColumn("section", F.row_number().over(Window.partitionBy("volume_no").orderBy("block", "stretch", "part")))
    both = F.struct(F.col("p.original").alias("original"), F.col("p.modern").alias("modern"))
    found = found.withColumn("t", F.when((F.size("p.original") == 0) & (F.size("p.modern") >= 2), recovered_pairs(F.col("p.modern"))).otherwise(both))
    found = found.withColumns({"original_text": F.array_join("t.original", " "), "white_text": F.array_join("t.modern", " ")}).withColumns({f"{c}_title": F.col(f"p.{c}") for c in ("volume", "chapter", "year")})
    only_heading = (F.col("original_text") == "") & (F.col("white_text").isin(F.col("chapter_title"), F.col("year_title"), F.col("volume_title")) | (line_kind(F.col("white_text")) != "content"))
    pair = F.when((F.col("original_text") != "") & (F.col("white_text") != ""), "paired").when(F.col("original_text") != "", "original_only").otherwise("white_only")
    key = F.concat(F.lpad(F.col("volume_no").cast("string"), 3, "0"), numbered("-s", F.col("section"), 4))
    return found.where(~only_heading).select("volume_no", key.alias("section_key"), F.col("p.number").alias("section_index"), "volume_title", "chapter_title", "year_title", "original_text", "white_text", pair.alias("pair_type"))


def _with_inline_pairs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (volume_no, line, place, text) with paragraphs of an original and its translation cut in two (half 0 and 1).

    Every cut at a blank is a candidate whose left part meets the known originals in an equality join; paragraphs that are originals
    themselves, and those of volumes without originals, stay whole.
    """
    key = ["volume_no", "line", "place"]
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.when(F.substring("text", i, F.lit(1)) == " ", i)), lambda i: i.isNotNull())
    cut = rows.where(F.contains("text", F.lit(" "))).select(*key, "text", F.explode(cuts).alias("at"))
    cut = cut.select(*key, "at", F.col("text").alias("whole"), F.trim(F.left("text", F.col("at"))).alias("text"), F.trim(F.substring("text", F.col("at"), F.length("text"))).alias("right")).where("text <> '' and right <> ''")
    told = cut.join(known, ["volume_no", "text"], "left").join(known.select("volume_no", F.col("text").alias("whole"), F.lit(True).alias("is_original")), ["volume_no", "whole"], "left")
    told = told.join(known.select("volume_no", F.lit(True).alias("there")).distinct(), "volume_no").where("is_original is null")
    sure = F.coalesce("known", F.lit(False)) & is_modern(F.col("right"))
    likely = (F.col("text") == F.col("right")) | (F.right("text", F.lit(1)).isin(*"。！？；”’") & translation_like(F.col("right")))
    best = told.groupBy(*key).agg(F.max(F.when(sure, F.struct("at", "text", "right"))).alias("sure"), F.min(F.when(likely, F.struct("at", "text", "right"))).alias("likely"))
    best = best.select(*key, F.coalesce("sure", "likely").alias("pair")).where("pair is not null")
    halves = F.when(F.col("pair").isNull(), F.array("text")).otherwise(F.array("pair.text", "pair.right"))
    return rows.join(best, key, "left").select(*key, F.posexplode(halves).alias("half", "text"))


def inline_pair(text: Column, is_original: Column) -> Column:
    """A paragraph that holds an original and its translation, cut at the blank between; is_original: a function of a candidate left part.

    The last cut whose left part is an original and whose right part is modern; else the first one with equal parts, or an end mark
    on the left and a translation on the right; else the paragraph as it is.
    """
    cuts = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)) == " "), lambda i: F.struct(F.trim(F.left(text, i)).alias("l"), F.trim(F.substring(text, i, F.length(text))).alias("r")))
    cuts = F.filter(cuts, lambda c: (c["l"] != "") & (c["r"] != ""))
    sure = F.filter(cuts, lambda c: is_original(c["l"]) & is_modern(c["r"]))
    likely = F.filter(cuts, lambda c: (c["l"] == c["r"]) | (F.right(c["l"], F.lit(1)).isin(*"。！？；”’") & translation_like(c["r"])))
    best = F.when(F.size(sure) > 0, F.element_at(sure, -1)).otherwise(F.get(likely, F.lit(0)))
    return F.when(best.isNull(), F.array(text)).otherwise(F.array(best["l"], best["r"]))


def marked_sections(lines: DataFrame, doc: str = "doc", order: str = "line", text: str = "text") -> DataFrame:
    """Sections of an export with marked headings (== volume ==, ## chapter, ### year, [key])."""
    t = F.trim(F.col(text))
    rows = lines.select(F.col(doc).alias("doc"), F.col(order).alias("line"), t.alias("text")).where("text <> ''")
    t = F.col("text")
    key = F.regexp_extract(t, r"^\[(\d{3}-s\d{4})\]$", 1)
    kind = F.when(t.rlike(r"^=+ 卷 \d+ \|"), "volume").when(t.rlike("^## "), "chapter").when(t.rlike("^### "), "year").when(key != "", "key").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("head", F.when(kind == "volume", F.regexp_extract(t, r"\|\s*(.*?)\s*=+$", 1)).when(kind == "key", key).otherwise(F.trim(F.regexp_replace(t, "^#+ ", ""))))
    rows = carried(rows, "doc", "line", F.col("kind"), "head", ["volume", "chapter", "year", "key"])
    texts = rows.where("kind = 'text' and key <> ''").groupBy("doc", "volume", "chapter", "year", "key").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("p"), F.min("line").alias("ordinal"))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), " "), SPACE, " "))
    return texts.select("doc", "ordinal", F.col("key").alias("section_key"), "volume", "chapter", "year", joined.alias("white_text")).where("white_text <> ''")


def fact_and_comment(text: Column, markers: list[str]) -> Column:
    """struct(fact, comment): cut at the first of the markers."""
    first = F.lit(None).cast("int")
    for marker in markers:
        first = F.least(first, F.nullif(F.instr(text, marker), F.lit(0)))
    return F.struct(F.trim(F.when(first.isNull(), text).otherwise(F.left(text, first - 1))).alias("fact"), F.when(first.isNull(), F.lit("")).otherwise(F.trim(F.substring(text, first, F.length(text)))).alias("comment"))


def commentaries(sections: DataFrame, markers: list[str], order: str = "ordinal", text: str = "white_text") -> tuple[DataFrame, DataFrame]:
    """(sections with their facts only, comments numbered in order per document with the key of their section)."""
    cut = sections.withColumn("__cut", fact_and_comment(F.col(text), markers))
    facts = cut.withColumn(text, F.col("__cut.fact")).drop("__cut")
    comments = cut.where("__cut.comment <> ''").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy(order)))
    return facts, comments.select("doc", numbered("m", F.col("n")).alias("commentary_id"), "section_key", F.col("__cut.comment").alias("commentary_text"), F.length("__cut.comment").alias("chars"))


def flat_elements(html: Column, tags: list[str] = ["h1", "h2", "h3", "p", "blockquote"]) -> Column:  # noqa: B006
    """Array of struct(tag, text): elements without elements of these tags inside, tags within dropped, blanks collapsed."""
    names = "|".join(tags)
    raw = F.regexp_extract_all(text_or_empty(html), F.lit(rf"(?s)<(?:{names})(?:\s[^>]*)?>(?:(?!<(?:{names})[\s>]).)*?</(?:{names})>"), F.lit(0))
    out = F.transform(raw, lambda e: F.struct(F.regexp_extract(e, r"^<([a-z0-9]+)", 1).alias("tag"), F.trim(F.regexp_replace(F.regexp_replace(e, "<[^>]+>", " "), r"\s+", " ")).alias("text")))
    return F.filter(out, lambda e: e["text"] != "")


BLOCKS = ("h1", "h2", "h3", "p", "blockquote")


def parsed_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, place, tag, text: the texts of the blocks of a page, in the order in which they end, page by page in the workers.

    A page is a stream of events (begin, end, text). A begin of a heading or a paragraph ends an open heading or paragraph; a blockquote
    may hold others. An end tag ends its block and all that is open within. What is open at the end of the page ends there. Text outside
    of blocks, and in scripts and styles, is left out. Null html has no blocks; a very long page is one event stream.
    """
    import pyarrow as pa

    def run(batches):
        from html.parser import HTMLParser

        class Events(HTMLParser):
            def __init__(self, emit):
                super().__init__()
                self.handle_starttag = lambda tag, attrs: emit("begin", tag)
                self.handle_endtag = lambda tag: emit("end", tag)
                self.handle_data = lambda data: emit("text", data)

        def blocks(html):
            stack, done, hidden = [], [], set()

            def close(down_to):
                while len(stack) > down_to:
                    tag, words = stack.pop()
                    if words:
                        done.append((tag, " ".join(words)))

            def event(kind, what):
                if kind == "text":
                    if stack and not hidden:
                        stack[-1][1].extend(what.split())
                elif what in ("script", "style"):
                    (hidden.add if kind == "begin" else hidden.discard)(what)
                elif what in BLOCKS and kind == "begin":
                    if stack and stack[-1][0] != "blockquote":
                        close(len(stack) - 1)
                    stack.append((what, []))
                elif what in BLOCKS and any(tag == what for tag, _ in stack):
                    close(max(n for n, (tag, _) in enumerate(stack) if tag == what))

            parser = Events(event)
            parser.feed(html)
            parser.close()
            close(0)
            return done

        for batch in batches:
            rows = [(i, n, tag, text) for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, (tag, text) in enumerate(blocks(html or ""))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["id", "place", "tag", "text"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, "id long, place int, tag string, text string")


def element_chunks(elements: DataFrame, least: int = 8) -> DataFrame:
    """Text elements with their headings h1 > h2 > h3 carried, annotations ［…］ taken out; short ones left out."""
    rows = carried(elements, "id", "place", F.col("tag"), "text", ["h1", "h2", "h3"])
    notes = F.regexp_extract_all("text", F.lit("［([^］]*)］"), F.lit(1))
    body = F.trim(F.regexp_replace("text", "［[^］]*］", ""))
    return rows.where(F.col("tag").isin("p", "blockquote")).select("id", "place", "h1", "h2", "h3", body.alias("text"), notes.alias("notes")).where(F.length("text") >= least)


def original_paragraphs(lines: DataFrame, header: str, order: str = "line", text: str = "text", doc: str = "doc") -> DataFrame:
    """doc, volume (running number of the header lines that start a volume), text: distinct content paragraphs of a whole-book text. A header
    that is followed by another one, or by a contents line, starts nothing."""
    w = Window.partitionBy(doc).orderBy(order)
    follows = F.lead(text).over(w)
    starts = F.col(text).rlike(header) & ~F.coalesce(follows.rlike(header) | follows.isin("目录", "Cover Page"), F.lit(False))
    rows = lines.withColumn("volume", F.sum(starts.cast("int")).over(w))
    return rows.where((F.col("volume") > 0) & ~F.col(text).rlike(header) & (line_kind(F.col(text)) == "content")).select(doc, "volume", text).distinct()


SENTENCE = CJK_SENTENCE
