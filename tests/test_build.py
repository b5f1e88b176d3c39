"""From volume files to sections, chunks and commentaries."""

import json

from pyspark.sql import functions as F

from scriptorium.operators import sections
from scriptorium.plans import build

LINES = ["第一卷", "周纪一（公元前403年）", "威烈王二十三年（戊寅，公元前403年）", "[2]丙丙丙。[1]乙乙乙。", "[3]初命晋大夫。", "春季，周王下令任命晋国大夫。", "", "www.example.com"]


def _sections(spark, lines, originals=None):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "volume_no int, line int, text string")
    known = None if originals is None else spark.createDataFrame([(1, t) for t in originals], "volume_no int, text string")
    return sections.volume_sections(rows, known).orderBy("section_key").collect()


def test_sections_keep_the_order_within_a_line(spark):
    found = _sections(spark, LINES)
    assert [(r["section_index"], r["original_text"]) for r in found] == [(2, "丙丙丙。"), (1, "乙乙乙。"), (3, "初命晋大夫。")]
    assert found[2]["white_text"] == "春季，周王下令任命晋国大夫。" and found[2]["pair_type"] == "paired"
    assert {r["chapter_title"] for r in found} == {LINES[2]}


def test_a_repeated_title_does_not_part_a_section(spark):
    lines = ["威烈王二十三年（戊寅，公元前403年）", "[1]初命晋大夫。", "威烈王二十三年（公元前403年）", "春季，周王下令任命晋国大夫。", "威烈王二十三年（再，公元前403年）", "春季，又一段百姓的故事。"]
    found = _sections(spark, lines)
    assert [(r["original_text"], r["white_text"], r["pair_type"]) for r in found] == [("初命晋大夫。", lines[3], "paired"), ("", lines[5], "white_only")]
    other = _sections(spark, [lines[0], lines[1], "安王元年（庚辰，公元前401年）", lines[3]])
    assert [r["pair_type"] for r in other] == ["original_only", "white_only"]


def test_known_originals_decide(spark):
    modern = "春季，周王下令任命晋国大夫，百姓于是都来了。"
    assert [r["pair_type"] for r in _sections(spark, [f"[1]{modern}"])] == ["original_only"]
    assert [r["pair_type"] for r in _sections(spark, [f"[1]{modern}"], ["初命晋大夫。"])] == ["white_only"]
    both = _sections(spark, [f"初命晋大夫。 {modern}"], ["初命晋大夫。"])
    assert [(r["original_text"], r["white_text"]) for r in both] == [("初命晋大夫。", modern)]
    assert [r["original_text"] for r in _sections(spark, ["甲 乙"], ["甲 乙"])] == ["甲 乙"]


def test_open_blocks_end_where_the_next_begins(spark):
    pages = spark.createDataFrame([(1, "<p>one<p>two</p><h2>head<p>three<blockquote><p>in</blockquote>out<script>var p='<p>x</p>'</script>"), (2, None), (3, "")], "page_id long, html string")
    found = [(r["id"], r["tag"], r["text"]) for r in sections.parsed_elements(pages, "page_id", "html").orderBy("id", "place").collect()]
    assert found == [(1, "p", "one"), (1, "p", "two"), (1, "h2", "head"), (1, "p", "three"), (1, "p", "in")]


def test_files_to_chunks(spark, tmp_path):
    volumes = tmp_path / "volumes"
    volumes.mkdir()
    long = "春季，周王下令任命晋国大夫。" * 130
    body = [f"[{i}]初命晋大夫第{i}。\n春季，周王下令任命晋国大夫，百姓于是都来了，第{i}回。" for i in range(1, 90)]
    (volumes / "001.txt").write_bytes("\n".join([*LINES[:3], *body]).encode("gb18030"))
    (volumes / "002.txt").write_bytes("\n".join([*LINES[:3], "[1]初命。", long]).encode("gb18030"))
    (volumes / "notes.txt").write_bytes(b"not a volume")
    told = build.write(spark, str(volumes), str(tmp_path / "out"), "v1").first()
    assert (told["volumes"], told["sections"]) == (2, 90)
    rows = [json.loads(line) for f in (tmp_path / "out" / "chunks").glob("part-*") for line in f.read_text(encoding="utf-8").splitlines()]
    rows.sort(key=lambda r: r["chunk_id"])
    first = [r for r in rows if r["volume_no"] == 1]
    assert [r["chunk_id"] for r in first] == [f"chunk-v001-c{i:05d}" for i in range(1, len(first) + 1)] and len(first) > 1
    assert all(900 <= r["white_char_count"] <= 1600 for r in first[:-1])
    assert all(a["section_keys"][-1] == b["section_keys"][0] for a, b in zip(first, first[1:]))  # one section of overlap
    assert [k for r in first for k in r["section_keys"]][0] == "001-s0001" and first[-1]["section_keys"][-1] == "001-s0089"
    second = [r for r in rows if r["volume_no"] == 2]
    assert [r["chunk_id"] for r in second] == ["chunk-v002-c00001-p01", "chunk-v002-c00001-p02"] and "".join(r["white_text"] for r in second) == long
    assert first[0]["source_priority"] == 0.9 and first[0]["pair_types"].startswith("paired:")


def test_commentaries_and_chunks_know_each_other(spark):
    text = ["== 卷 001 | 周纪 ==", "## 周纪一", "### 元年", "[001-s0001]", "事实一。臣光曰：评论一。", "[001-s0002]", "事实二。"]
    export = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, line int, text string")
    chunks, comments = build.tagging_build(sections.marked_sections(export), ["臣光曰"], "v1")
    made, told = chunks.collect(), comments.collect()
    assert [r["white_text"] for r in made] == ["事实一。\n事实二。"] and [r["commentary_text"] for r in told] == ["臣光曰：评论一。"]
    assert made[0]["commentary_ids"] == [told[0]["commentary_id"]] and told[0]["chunks"] == [made[0]["chunk_id"]]
    assert build.white_only(chunks.select("volume_no", F.lit("k").alias("section_key"), "chapter_title", "year_title", "white_text", F.lit("white_only").alias("pair_type"))).count() == 1
