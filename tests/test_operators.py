"""Operators on literal rows with results worked out by hand, and properties."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import lexicon
from scriptorium.operators import audit, case_merging, chunking, extraction, intent, merging, ordering, report, retrieval, sections, tagging
from scriptorium.plans import workflow
from scriptorium.sources import files
from scriptorium.streaming import append


def packs(spark, sizes, f=chunking.overlapping_packs, **k):
    row = spark.createDataFrame([(sizes,)], "s array<int>").select(f(F.col("s"), **k).alias("p")).first()
    return [(p["first"], p["last"]) for p in row["p"]]


def test_packing_cases(spark):
    assert packs(spark, [800, 700, 200]) == [(1, 2), (2, 3)]
    assert packs(spark, [1000, 500]) == [(1, 1), (1, 2)]
    assert packs(spark, [300, 1700, 300]) == [(1, 1), (2, 2), (3, 3)]
    assert packs(spark, []) == [] and packs(spark, [0, 0]) == []
    assert packs(spark, [3000, 2000, 1], chunking.sized_packs, target=5000) == [(1, 2), (3, 3)]


def test_packing_covers_everything(spark):
    rng = random.Random(1)
    for _ in range(12):
        sizes = [rng.randrange(1, 1800) for _ in range(30)]
        found = packs(spark, sizes)
        assert {i for a, b in found for i in range(a, b + 1)} == set(range(1, 31))
        assert all(a == b or sum(sizes[a - 1 : b]) + (b - a) <= 1600 for a, b in found)
        assert found == sorted(found)


def test_character_windows(spark):
    row = spark.range(1).select(chunking.character_windows(F.lit("x" * 3000)).alias("w"), chunking.character_windows(F.lit("")).alias("e")).first()
    assert [w["start"] for w in row["w"]] == [0, 1160, 2320] and row["w"][-1]["start"] + len(row["w"][-1]["text"]) == 3000 and row["e"] == []


def test_runs_titles_histogram_links(spark):
    rows = spark.createDataFrame([("d", i, k) for i, k in enumerate("ABA")], "doc string, o int, k string")
    assert [r["run"] for r in ordering.run_numbers(rows, ["doc"], "o", ["k"]).orderBy("o").collect()] == [1, 2, 3]
    row = spark.range(1).select(chunking.merged_titles(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a"))).alias("t"), chunking.histogram_text(F.array(F.lit("x"), F.lit("y"), F.lit("x"))).alias("h")).first()
    assert row["t"] == "a – b" and row["h"] == "x:2,y:1"
    members = spark.createDataFrame([("m1", "k1"), ("m2", "k9")], "m string, key string")
    chunks = spark.createDataFrame([("c2", ["k1"]), ("c1", ["k1", "k2"])], "chunk_id string, keys array<string>")
    assert {r["m"]: r["chunks"] for r in chunking.links(members, chunks, "key", "m").collect()} == {"m1": ["c1", "c2"], "m2": []}


def test_fusion(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query_id int, item_id string, rank int")
    a, b = rank([(1, "x", 1), (1, "y", 2)]), rank([(1, "x", 1)])
    found = {r["item_id"]: r["score"] for r in retrieval.fused({"a": a, "b": b}).collect()}
    assert found == {"x": 0.032787, "y": 0.016129}
    other = {r["item_id"]: r["score"] for r in retrieval.fused({"b": b, "a": a}).collect()}
    assert other == found
    assert retrieval.branch_limit(2) == 12 and retrieval.branch_limit(50) == 200


def test_expansion_frees_what_was_not_used(spark):
    hits = spark.createDataFrame([(1, "p", 1, 0.9), (1, "q", 2, 0.8)], "query_id int, item_id string, rank int, score double")
    members = spark.createDataFrame([("p", ["a", "b", "c"]), ("q", ["c", "d", "e"])], "item_id string, members array<string>")
    assert [r["member"] for r in retrieval.expanded(hits, members).orderBy("place").collect()] == ["a", "b", "c", "d"]
    assert retrieval.expanded(hits, members, in_all=3).count() == 3


def test_excerpt_and_rerank_and_evaluation(spark):
    sentence = F.array(*[F.lit(s) for s in ("one.", "two cats.", "three.", "four.")])
    row = spark.range(1).select(retrieval.excerpt(sentence, F.array(F.lit("dogs"), F.lit("cats"))).alias("x"), retrieval.excerpt(sentence, F.array(F.lit("zz"))).alias("y")).first()
    assert row["x"] == "one. two cats. three." and row["y"] == "one."
    hits = spark.createDataFrame([(1, f"i{n}", n, 1.0 / n) for n in range(1, 7)], "query_id int, item_id string, rank int, score double")
    model = spark.createDataFrame([(1, "i5", 9.0)], "query_id int, item_id string, model_score double")
    best = retrieval.reranked(hits, model).orderBy("rank").collect()
    assert [(r["item_id"], r["score"]) for r in best] == [("i5", 1.0), ("i1", 0.9), ("i2", 0.8), ("i3", 0.7)]
    truth = spark.createDataFrame([(1, "i3", "t"), (2, "i1", "t")], "query_id int, item_id string, kind string")
    overall = [r for r in retrieval.evaluated(hits, truth, ["kind"]).collect() if r["kind"] is None][0]
    assert (overall["n"], overall["hit_rate"], overall["mrr"]) == (2, 0.5, 0.166667)


def test_roles_and_merging(spark):
    rows = spark.createDataFrame([("决策者", ""), ("叛将", ""), ("庶兄", ""), ("大将", ""), ("策略建议者与幕僚", ""), ("书生", ""), ("", ""), (None, "")], "r string, s string")
    assert [x["c"] for x in rows.select(merging.canonical_role(F.col("r")).alias("c")).collect()] == ["最高决策者/组织负责人", "一线负责人/关键执行者", "继承竞争者/内部挑战者", "一线负责人/关键执行者", "策略建议者/说服者", "书生", "", ""]
    first = lexicon.ROLE_MAP[0]
    modern = spark.createDataFrame([(first[0], ""), ("无名", "")], "r string, s string").select(merging.modern_role(F.col("r"), F.col("s")).alias("m")).collect()
    assert modern[0]["m"] == first[1] and modern[1]["m"] == "无名"
    pressed = spark.createDataFrame([("国君", "压迫")], "r string, s string").select(merging.modern_role(F.col("r"), F.col("s")).alias("m")).first()
    assert pressed["m"] == "外部强势方/压力来源"
    actors = spark.createDataFrame([("c", "吴起", "将", 0), ("c", "文侯", "君", 1), ("c", "吴起", "大将军", 2)], "case string, name string, role string, position int")
    assert [(r["name"], r["role"]) for r in merging.merged_actors(actors, "case").orderBy("place").collect()] == [("吴起", "大将军"), ("文侯", "君")]


def test_near_duplicates(spark):
    long = "the quick brown fox jumps over the lazy dog again and again"
    rows = spark.createDataFrame([(1, long, "x"), (2, long + "!", "x"), (3, long, "y"), (20, long, "x"), (None, long, "x"), (4, "", "x"), (5, None, "x")], "o long, t string, b string")
    assert [(r["a"], r["b"], r["similarity"]) for r in merging.adjacent_near_duplicates(rows, "o", "t", ["b"]).collect()] == [(1, 2, 1.0)]
    folded = merging.folded_near_duplicates(rows.where("o is not null"), "b", "o", "t")
    assert {r["o"]: r["merged_into"] for r in folded.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 20: 1}
    again = merging.folded_near_duplicates(rows.where("o in (1, 3, 4)"), "b", "o", "t")
    assert all(r["o"] == r["merged_into"] for r in again.collect())


def test_intents(spark):
    asked = {"是谁杀了侠累": "factual_lookup", "吴起有哪些故事": "factual_lookup", "司马光怎么看智瑶": "commentary_lookup", "我被同事绕过汇报怎么办": "analysis", "带兵治军相关管理问题，吴起的故事能给我什么启发？": "analysis", "如何做红烧肉": "out_of_scope"}
    rows = spark.createDataFrame([(t,) for t in asked], "text string")
    assert {r["text"]: r["i"] for r in rows.select("text", intent.rule_intent(F.col("text")).alias("i")).collect()} == asked
    row = intent.analyzed(rows.where("text like '我被%'")).first()
    assert "沟通链路被绕过" in row["conflicts"] and row["scene"] in lexicon.SCENES and row["queries"][0].startswith("我被")
    best = spark.range(1).select(tagging.best_group(F.lit("b a"), {"x": ["a"], "y": ["b"], "z": ["q"]}).alias("s"), tagging.best_group(F.lit("-"), {"x": ["a"]}, "none").alias("d")).first()
    assert best["s"] == "y" and best["d"] == "none"


def test_sections(spark):
    lines = ["资治通鉴第一卷", "周纪一（公元前403年）", "[1]初命晋大夫魏斯为诸侯。", "[1]周威烈王开始任命晋国大夫魏斯为诸侯国君。", "[2]臣光曰：礼。[3]智伯。", "www.example.com", "-" * 30, "春季，因为百姓希望如此，所以国君决定去世。"]
    found = sections.volume_sections(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "volume_no int, line int, text string")).orderBy("section_key").collect()
    assert [(r["section_key"], r["section_index"], r["pair_type"]) for r in found] == [("001-s0001", 1, "paired"), ("001-s0002", 2, "original_only"), ("001-s0003", 3, "paired")]
    assert found[0]["volume_title"] == "资治通鉴第一卷" and found[0]["chapter_title"].startswith("周纪一") and found[0]["original_text"] == "初命晋大夫魏斯为诸侯。"
    marked = ["== 卷 001 | 周纪 ==", "## c1", "### y1", "[001-s0001]", "first", "臣光曰：second", "[001-s0002]", "## c2", "[001-s0003]", "third"]
    parsed = sections.marked_sections(spark.createDataFrame([("d", i, t) for i, t in enumerate(marked)], "doc string, line int, text string"))
    assert [(r["section_key"], r["chapter"], r["year"], r["white_text"]) for r in parsed.orderBy("ordinal").collect()] == [("001-s0001", "c1", "y1", "first 臣光曰：second"), ("001-s0003", "c2", "", "third")]
    facts, comments = sections.commentaries(parsed, ["臣光曰"])
    assert [r["commentary_text"] for r in comments.collect()] == ["臣光曰：second"] and {r["white_text"] for r in facts.collect()} == {"first", "third"}
    pair = spark.range(1).select(sections.inline_pair(F.lit("甲乙。 春季，因为百姓"), lambda p: p == "甲乙。").alias("p")).first()
    assert pair["p"] == ["甲乙。", "春季，因为百姓"]


def test_html(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><h2>C</h2><p>a <b>long</b> text［n1］ here</p><blockquote>quoted <p>inner one</p></blockquote><p>short</p>"), (2, None)], "page_id long, html string")
    rows = sections.element_chunks(sections.parsed_elements(pages, "page_id", "html")).orderBy("place").collect()
    assert [(r["h1"], r["h2"], r["text"], r["notes"]) for r in rows][0] == ("T", "C", "a long text here", ["n1"])
    assert pages.select(F.size(sections.flat_elements(F.col("html"), ["h1"])).alias("n")).collect()[0]["n"] == 1


def test_extraction(spark):
    rows = spark.createDataFrame([("c1", ["s1", "s2"], "p1"), ("c2", ["s3"], "p2"), ("c3", ["s4"], "p3")], "chunk_id string, section_keys array<string>, prompt string")

    def model(texts):
        if texts[0] == "p3":
            raise ValueError("no")
        return ['text ```json\n{"cases": [{"title": "A b", "score": "0.7", "section_keys": ["s2", "zz"]}, {"title": "low", "score": "0.5"}], "global_notes": ["n", "n"]}\n``` more' if texts[0] == "p1" else "not json"]

    answered = extraction.answered(rows, model).cache()
    found = extraction.cases(answered).collect()
    assert [(r["case_id"], r["section_keys"], r["score"], r["source_priority"]) for r in found] == [("case-c1-01-A-b", ["s2"], 0.7, 0.85)]
    outcome = {r["chunk_id"]: (r["cases_returned"], r["cases_accepted"], r["global_notes"]) for r in extraction.chunk_outcomes(answered, extraction.cases(answered)).collect()}
    assert outcome["c1"] == (2, 1, ["n"]) and outcome["c2"][0] == 0
    assert answered.where("error is not null").count() == 1
    maps = spark.range(1).select(extraction.section_texts(F.array(F.lit("a"), F.lit("b")), F.lit("x\ny")).alias("m"), extraction.section_texts(F.array(F.lit("a")), F.lit("x\ny")).alias("n")).first()
    assert maps["m"] == {"a": "x", "b": "y"} and maps["n"] == {"a": "x\ny"}


def test_audit(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "", "x"), (3, "a", "y")], "id int, t string, u string")
    assert {r["field"]: r["missing"] for r in audit.missing(rows, ["t", "u"]).collect()} == {"t": 1, "u": 1}
    assert audit.summary(rows.where("id > 9"), {"c": F.col("t") == "a"}, {}).first()["c_share"] == 0.0
    assert audit.length_stats(rows, F.length("t"), []).first()["longest"] == 1
    lines = audit.markdown("Title", rows, ["id", "t"]).orderBy("number").collect()
    assert lines[0]["line"] == "# Title" and len(lines) == 6


def test_report(spark):
    row = spark.range(1).select(report.diagram(F.array(F.lit("a[b]"), F.lit("c")), F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit("l|x").alias("label")))).alias("d")).first()
    assert row["d"] == "graph TD\n  n0[ab]\n  n1[c]\n  n0 -->|lx| n1"
    assert spark.range(1).select(report.safe_diagram(F.lit("graph TD\n click x")).alias("s")).first()["s"] is False
    evidence = spark.createDataFrame([(1, 1, "c1", 0.6), (1, 2, "c1", 0.5), (1, 3, "c2", 0.2)], "query_id int, place int, member string, score double")
    titles = spark.createDataFrame([("c1", "One")], "member string, title string")
    assert [(r["member"], r["title"], r["usage"], r["confidence"]) for r in report.citations(evidence, titles).orderBy("place").collect()] == [("c1", "One", "direct", 0.92), ("c2", "", "background", 0.68)]


def test_workflow(spark):
    questions = spark.createDataFrame([(1, "我的 alpha beta 怎么办"), (2, "如何做红烧肉")], "query_id int, text string")
    cases = spark.createDataFrame([(1, "alpha beta", "alpha", 0.5), (2, "gamma", "beta", 0.5)], "item_id int, sparse string, dense string, priority double")
    members = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "item_id int, members array<string>")
    found = {r["query_id"]: r for r in workflow.answered(questions, cases, members).collect()}
    assert found[1]["evidence"] == ["a", "b", "c"] and found[1]["passed"] and found[2]["intent"] == "out_of_scope" and found[2]["evidence"] == []


def test_files_and_resume(spark, tmp_path):
    (tmp_path / "vol").mkdir()
    (tmp_path / "vol" / "001.txt").write_bytes("卷一\n正文".encode("gb18030"))
    (tmp_path / "vol" / "notes.txt").write_text("no")
    assert [(r["volume_no"], r["text"]) for r in files.text_volumes(spark, str(tmp_path / "vol")).orderBy("line").collect()] == [(1, "卷一"), (1, "正文")]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "chunk_id string, n int")
    cases = spark.createDataFrame([(["b"],)], "chunk_ids array<string>")
    assert [r["chunk_id"] for r in files.pending(rows, rows.where("n = 1"), cases).collect()] == ["c"]
    files.write_json(rows, str(tmp_path / "j"))
    assert files.json_rows(spark, str(tmp_path / "j"), "chunk_id string, n int").count() == 3
    (tmp_path / "bad.json").write_text('{"chunk_id": "x", "n": 1}\n{broken\n')
    assert files.json_rows(spark, str(tmp_path / "bad.json"), "chunk_id string, n int").count() == 1
    import zipfile

    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("text/2.html", "<p>two</p>")
        z.writestr("text/1.html", "<p>one</p>")
    assert [r["html"] for r in files.epub_pages(spark, str(tmp_path)).collect()] == ["<p>one</p>", "<p>two</p>"]
    heads = spark.createDataFrame([("d", 1, "v", "c", "t1"), ("d", 2, "v", "c", "t2"), ("d", 3, "v", "e", "t3")], "doc string, o int, v string, c string, t string")
    assert [r["line"] for r in files.with_changed_headings(heads, "doc", "o", ["v", "c"], "t").orderBy("o", "place").collect()] == ["# v", "## c", "t1", "t2", "## e", "t3"]


def test_stream_appends_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, ts timestamp, kind string"
    make = lambda n: spark.range(n).select("id", F.lit("2024-01-01 00:30:00").cast("timestamp").alias("ts"), F.lit("k").alias("kind"))
    make(3).write.parquet(source)
    run = lambda: append.append_new(spark, source, schema, lambda r: r.select("id"), target, check).awaitTermination()
    run()
    make(2).write.mode("append").parquet(source)
    run()
    run()
    assert spark.read.parquet(target).count() == 5
    counted = append.windowed_counts(spark.read.parquet(source), "ts", ["kind"]).first()
    assert counted["n"] == 5


def test_corpus_sources(spark, tmp_path, monkeypatch):
    from scriptorium.sources import corpus

    seed = spark.createDataFrame([("seed",)], "chunk_id string")
    assert corpus.load(spark, None, None, seed, "NO_SUCH").first()["chunk_id"] == "seed"
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "c1", "source_priority": 0.5}\n')
    assert corpus.load(spark, str(tmp_path / "c.json"), None, seed, "NO_SUCH").first()["chunk_id"] == "c1"
    monkeypatch.setenv("SOME_CORPUS", str(tmp_path / "c.jsonl"))
    assert corpus.load(spark, "/nowhere", None, seed, "SOME_CORPUS").count() == 1
    sections_ = spark.createDataFrame([("v", i, f"k{i}", "x" * 3, f"y{i % 2}", "paired") for i in range(3)], "vol string, o int, section_key string, text string, year string, pair_type string")
    packed = spark.createDataFrame([("v", 1, 1, 2), ("v", 2, 2, 3)], "vol string, pack int, first int, last int")
    made = corpus.assembled(sections_, packed, ["vol"], "o", "t-v1").orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["section_keys"], r["year"], r["pair_types"], r["chars"]) for r in made] == [("v-c00001", ["k0", "k1"], "y0 – y1", "paired:2", 6), ("v-c00002", ["k1", "k2"], "y1 – y0", "paired:2", 6)]
    rows = spark.createDataFrame([(1, ["b", "zz", "a", "b"]), (2, [])], "id int, keys array<string>")
    order = spark.createDataFrame([("a", 2), ("b", 1)], "k string, o int")
    assert {r["id"]: r["keys"] for r in corpus.sorted_by_catalog(rows, "id", "keys", order, "k", ["o"]).collect()} == {1: ["b", "a", "zz"], 2: []}
    meta = files.vector_index(order, "k", "k")
    assert corpus.status(rows, meta, meta).first()["mode"] == "dense and sparse"


def _plain_merged(rows):
    """The fold of near duplicates over cases in corpus order, one by one."""
    import re

    norm = lambda t: re.sub(r"[^\w]", "", t or "").lower()
    told = lambda c: " ".join(x for x in (norm(c[f]) for f in ("title", "conflict", "pattern"))).strip()
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 2 else ({t} if t else set())

    def union(a, b):
        key = lambda c: (c["score"], len(told(c)), len(c["summary"]))
        x, y = (b, a) if key(b) > key(a) else (a, b)
        out = dict(x)
        for f in ("title", "summary", "conflict", "pattern"):
            out[f] = y[f] if not x[f] or (y[f] and len(y[f]) > len(x[f]) + 20) else x[f]
        for f in ("sections", "chunks"):
            out[f] = sorted(set(x[f]) | set(y[f]))
        out["tags"] = list(dict.fromkeys(x["tags"] + y["tags"]))
        out["score"], out["priority"] = max(a["score"], b["score"]), max(a["priority"], b["priority"])
        out["ordinal"], out["position"] = min((a["ordinal"], a["position"]), (b["ordinal"], b["position"]))
        out["merged"] = a["merged"] + b["merged"] + 1
        return out

    groups = {}
    for c in sorted(rows, key=lambda c: c["case_id"]):
        groups.setdefault((c["actor"], c["kind"], tuple(c["sections"]), norm(c["title"]), norm(c["conflict"])), []).append(c | {"merged": 0})
    exact = []
    for of in groups.values():
        one = of[0]
        for c in of[1:]:
            one = union(one, c)
        exact.append(one)
    kept = []
    for c in sorted(exact, key=lambda c: (c["ordinal"], c["position"], c["actor"], -c["score"], c["case_id"])):
        for i in range(len(kept) - 1, max(-1, len(kept) - 6), -1):
            k = kept[i]
            if (k["actor"], k["kind"]) != (c["actor"], c["kind"]):
                continue
            overlap = bool(set(k["sections"]) & set(c["sections"]))
            if not overlap and abs(k["ordinal"] - c["ordinal"]) > 1:
                continue
            x, y = grams(norm(told(k))), grams(norm(told(c)))
            alike = len(x & y) / len(x | y) if x and y else 0
            if alike >= 0.82 or (overlap and alike >= 0.72):
                kept[i] = union(k, c)
                break
        else:
            kept.append(c)
    return kept


def test_cases_merge_as_in_a_plain_fold(spark):
    import random

    rng = random.Random(4)
    base = ["the king of the north held his gate against the river men", "a minister asked for leave and went home", "three envoys came with gifts and left with promises", "the army crossed at night"]
    rows = []
    for i in range(140):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["gold", "horse", "letter"])
        ordinal = i // 3 + (i // 40) * 5
        rows.append({
            "case_id": f"c{i:03d}", "actor": rng.choice(["a", "b"]), "kind": rng.choice(["x", "x", "y"]), "title": " ".join(words), "conflict": rng.choice(["", "fear"]), "pattern": "", "summary": "s" * rng.randrange(60),
            "sections": sorted({f"{ordinal:04d}", f"{ordinal + rng.randrange(2):04d}"}), "chunks": [f"k{ordinal:04d}"], "tags": rng.sample(["t1", "t2", "t3"], 2), "score": rng.randrange(5) / 10, "priority": 0.85, "ordinal": ordinal, "position": rng.randrange(3),
        })
    kinds = "case_id string, actor string, kind string, title string, conflict string, pattern string, summary string, sections array<string>, chunks array<string>, tags array<string>, score double, priority double, ordinal int, position int, book string"
    frame = spark.createDataFrame([[*r.values(), "b"] for r in rows], kinds)
    want = _plain_merged(rows)
    got = [r.asDict() for r in case_merging.merged_cases(frame, ["book"]).collect()]
    shown = lambda c: (c["case_id"], c["actor"], c["kind"], c["title"], c["summary"], tuple(c["sections"]), tuple(c["chunks"]), tuple(c["tags"]), c["score"], c["ordinal"], c["position"], c["merged"])
    assert sorted(map(shown, got)) == sorted(map(shown, want)) and any(c["merged"] for c in want)
    assert case_merging.merged_cases(frame.where("false"), ["book"]).count() == 0


def test_stretches_of_cases_do_not_look_ahead_row_by_row(spark):
    import random

    rng = random.Random(7)
    rows = [(book, o, sorted({f"{o // 6:05d}", f"{o // 6 + rng.choice([0, 0, 0, 0, 9]):05d}"}) if rng.random() < 0.9 else None) for book in ("a", None) for o in sorted(rng.sample(range(4000), 1500)) for _ in range(rng.choice([1, 1, 2]))]
    rows += [("a", None, ["00000"]), ("c", None, None)]
    frame = spark.createDataFrame(rows, "book string, ordinal int, sections array<string>")
    want = {}
    for book in ("a", None, "c"):
        own = sorted((10**9 if o is None else o, s or []) for b, o, s in rows if b == book)
        begun = reach = last = None
        lows, low = [], None
        for _, s in reversed(own):
            low = min(x for x in (low, *s) if x is not None) if low or s else None
            lows.append(low)
        for (o, s), ahead in zip(own, reversed(lows)):
            if last is None or (o - last > 1 and (ahead is None or reach is None or ahead > reach)):
                begun = o
            want[book, o], last = begun, o
            reach = max(x for x in (reach, *s) if x is not None) if reach or s else None
    found = case_merging.stretches(frame, ["book"])
    assert {(r["book"], r["place"]): r["stretch"] for r in found.collect()} == want and 5 < len(set(want.values())) < 1500
    plan = found._jdf.queryExecution().toString().lower()
    assert "unboundedfollowing" not in plan


def test_a_long_stretch_of_cases_merges_as_in_a_plain_fold(spark):
    rows = [
        {"case_id": f"c{i:04d}", "actor": "a", "kind": "x", "title": f"{'the same old story of a king' if i % 3 else 'others'} {i % 7 if i % 3 else i * 7919}", "conflict": "", "pattern": "İ" * (i % 2), "summary": "s" * (i % 50), "sections": [f"{i // 4:04d}", f"{i // 4 + 1:04d}"], "chunks": [f"k{i:04d}"],
         "tags": [f"t{i % 3}"], "score": i % 5 / 10, "priority": 0.85, "ordinal": i, "position": i % 2}
        for i in range(2000)
    ]
    kinds = "case_id string, actor string, kind string, title string, conflict string, pattern string, summary string, sections array<string>, chunks array<string>, tags array<string>, score double, priority double, ordinal int, position int, book string"
    frame = spark.createDataFrame([[*r.values(), "b"] for r in rows], kinds)
    assert case_merging.stretches(frame, ["book"]).select("stretch").distinct().count() == 1
    shown = lambda c: (c["case_id"], c["title"], c["summary"], tuple(c["sections"]), tuple(c["chunks"]), tuple(c["tags"]), c["score"], c["ordinal"], c["position"], c["merged"])
    found = case_merging.merged_cases(frame, ["book"])
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # a stretch is not gathered into one row
    assert sorted(shown(r.asDict()) for r in found.collect()) == sorted(map(shown, _plain_merged(rows)))


def test_blocked_dense_ranking_gives_what_all_pairs_give(spark):
    import random

    rng = random.Random(11)
    odd = [None, [], [0.5, None], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 1.0], [1.0, 2.0], [0.005, 0.01, 0.0]]
    vector = lambda: rng.choice(odd) if rng.random() < 0.02 else [rng.choice([0.005, 0.01, 0.25, -0.5, rng.random()]) for _ in range(3)]
    rows = [(i, f"v{i % 2500:04d}" if i % 97 else None, vector()) for i in range(2500)]
    corpus = spark.createDataFrame(rows, "item_id long, name string, vector array<double>").repartition(2)
    asked = corpus.where("item_id % 40 = 0").select(F.col("item_id").alias("query_id"), "vector").unionByName(corpus.where("item_id in (1, 2, 3)").select((F.col("item_id") * 40).alias("query_id"), "vector"))
    every = retrieval.dense_scores(asked, corpus, digits=2)
    shown = lambda rows: sorted(map(str, rows.select("query_id", rows.columns[1], "score", "rank").collect()))
    for limit in (1, 7, 2000):
        assert shown(retrieval.dense_ranked(asked, corpus, limit, digits=2)) == shown(retrieval.ranked(every, "query_id", "item_id", "score", limit))
        assert shown(retrieval.dense_ranked(asked, corpus, limit, digits=2, but_own=True)) == shown(retrieval.ranked(every.where("query_id <> item_id"), "query_id", "item_id", "score", limit))
    named = corpus.where("name is not null")
    assert shown(retrieval.dense_ranked(asked, named, 5, item="name", digits=2)) == shown(retrieval.ranked(retrieval.dense_scores(asked, named, item="name", digits=2), "query_id", "name", "score", 5))
    assert retrieval.dense_ranked(asked.where("false"), corpus, 5).count() == 0 == retrieval.dense_ranked(asked, corpus.where("false"), 5).count()


def test_dense_queries_score_blocks_not_rows(spark):
    from scriptorium.plans import catalogue

    found = catalogue.dense_topk(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_a_branch_is_worked_out_once_though_it_gives_hits_and_stops_the_next(spark):
    slow = spark.range(4).mapInArrow(lambda batches: batches, "id long").select(F.col("id").alias("query_id"), F.lit(1).alias("item_id"))
    found = retrieval.first_with_hits([slow, None, spark.createDataFrame([(2, 7), (9, 8)], "query_id long, item_id int")])
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in found.select("query_id", "item_id", "branch").collect()) == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (9, 8, 2)]
