"""Url rules, conversation repair and tokenizer alignment against brute force, with edge cases."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import alignment, conversations, url_rules
from scriptorium.llm.queries import damaged, tokenizer_file

RANKS, PIECES = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model")


# Url rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("", "", "block"), ("b.com", "/x", "allow"), ("com", "/xyz", "block"), ("org", "", "allow"), ("org", "", "block"), (None, "/q", "allow")]
URLS = [
    None, "", "no scheme", "http://a.example.com/en/1", "http://www.EXAMPLE.com/en/1?x=/de/", "http://www.example.com:80/en/", "http://example.com", "http://example.com?/en/", "http://notexample.com/en/",
    "http://b.com/xyz", "http://a.net/es/", "http://a.net/ES/", "http://x.org/", "http://x.org", "ftp://É.com/en/", "http:///en/", "http://a..com/", "http://com./", "://net/es/#", "http://a.b.com/x#frag", "a://b://c.net/es/", "http://u@net/es/x",
    "http://" + "a." * 3000 + "com/" + "x" * 5000, "http://h/q\n/r", "http://h\n.net/es/",
]


def _plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda text, marks: min([text.index(m) for m in marks if m in text], default=len(text))
    host = rest[: cut(rest, "/?#")]
    path = rest[len(host) :][: cut(rest[len(host) :], "?#")]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len((h or "") + p), len(h or ""), v, (h or "") + p) for h, p, v in RULES if (host == (h or "") or host.endswith("." + (h or ""))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("bound", [200_000, 0])
def test_urls_match_plain_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound)
    rows = [(i, u, "x", "y", "z", "w") for i, u in enumerate(URLS)] + [(None, URLS[3], "", "", "", ""), (3, URLS[3], "", "", "", "")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, prefix string, digest string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = Counter(tuple(r) for r in url_rules.judged(pages, rules).collect())
    assert found == Counter((i, *_plain(u)) for i, u, *_ in rows)
    assert url_rules.judged(pages.limit(0), rules).count() == 0
    assert {(r["rule"], r["verdict"]) for r in url_rules.judged(pages, rules.limit(0), default="block").collect()} == {(None, "block")}


# Conversation repair


def cheapest(rows, start=0, ends=(0, 3)):
    """Least cost and audit by a table over places and states."""
    best = {start: (0, "")}

    def inserted(states):
        for _ in range(4):
            for state, (cost, audit) in list(states.items()):
                to = conversations.INTO[state]
                states[to] = min(states.get(to, (1 << 30, "")), (cost + 2, audit + "I"))
        return states

    for initial, fault in rows:
        after = {}
        for state, (cost, audit) in inserted(best).items():
            ways = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways.append((conversations.INTO[state], cost + 2 + more, "R"))
                if initial in conversations.KEEPS[state]:
                    ways.append((conversations.KEEPS[state][initial], cost + more, "K"))
            for to, total, letter in ways:
                after[to] = min(after.get(to, (1 << 30, "")), (total, audit + letter))
        best = after
    return min((x for state, x in inserted(best).items() if state in ends), default=None)


TURNS = st.lists(st.tuples(st.sampled_from(["s", "u", "u", "a", "a", "t", ""]), st.sampled_from(["", "", "", "truncated", "blank", "duplicate"])), max_size=14)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_search_finds_the_cheapest_audit(rows):
    assert conversations.Search(rows, (0, 3)).answer(0) == cheapest(rows)
    for (start, end), found in conversations.states(rows).items():
        assert found == cheapest(rows, start, (end,))


def test_stretches_compose(monkeypatch):
    rng = random.Random(5)
    for n in (65, 200, 700):
        rows = [(rng.choice("uuaas?"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
        assert conversations.audit(rows) == cheapest(rows)[1]
    monkeypatch.setattr(conversations, "STRETCH", 3)
    for _ in range(200):
        rows = [(rng.choice("uuaas?"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(12))]
        assert conversations.audit(rows) == cheapest(rows)[1]


def _report(turns):
    """Report of one conversation's rows (turn, role, text) in order."""
    seen, rows, counts = set(), [], Counter()
    for turn, role, text in turns:
        bare = text.strip(conversations.BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        rows.append((role[:1], fault))
    cost, audit = cheapest(rows)
    said, state, rest = [], 0, iter(turns)
    for letter in audit:
        if letter == "I":
            state = conversations.INTO[state]
            said.append(f"{conversations.ROLE[state]}:")
            continue
        _, role, text = next(rest)
        if letter != "D":
            state = conversations.KEEPS[state][role[:1]] if letter == "K" else conversations.INTO[state]
            said.append(f"{role if letter == 'K' else conversations.ROLE[state]}:{text}")
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def _turns():
    rng = random.Random(9)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(["Yes.", "No", " \n", None, "Tell me! \t", "Again", "é?"]), True))
    rows += [(77, t, rng.choice(["user", "assistant"]), rng.choice([f"Line {t}.", f"Line {t}", "Same."]), True) for t in range(900)]  # a large conversation
    rows += [(78, 1, "user", "x" * 100_000, True), (79, 1, "user", "Gone.", False), (80, 5, "user", "Stays.", True), (80, 6, "user", "Gone.", False), (80, 7, "assistant", "Yes.", None)]
    return rows


@pytest.mark.parametrize("parts", [1, 13])
def test_repairs_match_plain_ones(spark, parts):
    rows = _turns()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, present boolean, part string, digest string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        edits, report = conversations.repaired(frame, present=F.col("present"))
        found = {r[0]: tuple(r)[1:] for r in report.collect()}
        edits = edits.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    groups = defaultdict(list)
    for conv, turn, role, text, present in rows:
        groups[conv] += [(turn, role if role is not None else " ", text if text is not None else " ")] if present else []
    digest = lambda conv, role, text: hashlib.sha256("|".join(["-" if conv is None else f"{len(str(conv))}:{conv}", str(len(role)), role + text]).encode()).hexdigest()
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:256], digest(conv, t[1], t[2])))
    assert found == {conv: _report(turns) for conv, turns in groups.items()}
    assert found[79] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # The edited turns spell the audits.
    for conv in (77, 80, None):
        own = sorted((r["part"], r["place"], r["edit"]) for r in edits if r[0] == conv)
        assert "".join(x for *_, x in own) == found[conv][6]
    if parts > 1:
        assert len({r["part"] for r in edits if r[0] == 77}) > 1


def test_damage_and_empty_table(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in (1, 2, None) for t in [*range(40), None]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["present"]) for r in damaged(frame).collect())
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t, "user" if kind == 4 else role, {1: "", 2: "One Two"}.get(kind, text), kind != 0] += 2 if kind == 3 else 1
    assert found == want
    edits, report = conversations.repaired(frame.limit(0))
    assert not edits.count() and not report.count()


# Alignment


@functools.cache
def _models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves in byte-level entries
    spare = iter(range(256, 512))
    byte_of = {chr(b if b in kept else next(spare)): b for b in range(256)}
    return a, byte_of, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def _aligned(text):
    """A and B ids with the ends of their bytes, or nothing."""
    a, byte_of, b = _models()
    if not text:
        return [], []
    one = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if not b"".join(x for _, x in one) == b"".join(x for _, x in two) == (" " + text).encode():
        return [], []
    ends = lambda rows: [(i, sum(len(x) for _, x in rows[: n + 1])) for n, (i, _) in enumerate(rows)]
    return ends(one), ends(two)


def _scores(texts):
    found = []
    for text in texts:
        a, b = _aligned(text)
        common = sorted({e for _, e in a} & {e for _, e in b})
        links = [(i, j) for i, x in a for j, y in b if x == y]
        groups, low = [], 0
        for high in common:
            groups.append(",".join(str(i) for i, e in a if low < e <= high) + "|" + ",".join(str(j) for j, e in b if low < e <= high))
            low = high
        found.append((len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for f in found for x in f[3])
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(f[0], f[1], f[2], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found]


TEXTS = [None, "", " ", "a", "Hello world", "Hello  world\n\nagain", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café — ½ ﬁ ①", "日本語 テキスト 😀", "the the the the the", "x" * 300, "\t\r\n", "e\u0301", "▁ under", "the cat", "The cat sat. " * 20]


@pytest.mark.parametrize("bound,block", [(1_000_000, None), (0, None), (0, 5), (1_000_000, 5)])
def test_alignment_matches_brute_force(spark, monkeypatch, bound, block):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", bound)
    if block:
        monkeypatch.setattr(alignment, "BLOCK", block)
    texts = [*TEXTS, *TEXTS, TEXTS[9]]
    rows = [(None if i == 3 else i % 20, t, "x", "y", "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, block string, place string").repartition(3)
    found = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in alignment.alignment(docs, RANKS, PIECES).collect())
    assert found == Counter((r[0], *s) for r, s in zip(rows, _scores(texts)))
    counts = {(r["a"], r["b"]): (r["docs"], r["links"]) for r in alignment.pair_counts(alignment.aligned(docs, RANKS, PIECES)).collect()}
    want, docs_of = Counter(), Counter()
    for text in texts:
        a, b = _aligned(text)
        own = Counter((i, j) for i, x in a for j, y in b if x == y)
        want += own
        docs_of.update(own.keys())
    assert counts == {x: (docs_of[x], n) for x, n in want.items()}
    assert alignment.alignment(docs.limit(0), RANKS, PIECES).count() == 0


def test_bitmaps_of_either_kind():
    import numpy as np

    rng = random.Random(2)
    keys = [(pair << 16) | rng.randrange(900) for pair, n in ((7, 5), (8, 3000), (9, 400)) for _ in range(n)]
    rows = [r for batch in alignment.posting_batches(3, np.array(keys, np.uint64), 900) for r in batch.to_pylist()]
    assert {r["dense"] for r in rows} == {True, False}
    back, held = Counter(), defaultdict(list)
    for r in rows:
        held[r["pair"]].append((r["docs"], r["dense"]))
        for place in alignment.places(r["docs"], r["dense"]):
            back[(r["pair"] << 16) | int(place)] += 1 << r["plane"]
    assert back == Counter(keys)
    assert {p: alignment.popcount(b) for p, b in held.items()} == Counter(k >> 16 for k in set(keys))
    assert all(alignment.popcount([b]) == len(alignment.places(*b)) for bitmaps in held.values() for b in bitmaps)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_spelling_gives_the_tokenizers_ids(text):
    a, b = alignment.spelling(RANKS, PIECES).tokens(text)
    one, two = _aligned(text)
    assert a.tolist() == [i for i, _ in one] and b.tolist() == [j for j, _ in two]


# Repeated rows and missing labels in the earlier operators


def test_top_k_of_queries_that_share_an_id(spark):
    from scriptorium.llm import topk

    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), *[(i, [i / 10, 1 - i / 10]) for i in range(1, 8)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = Counter(tuple(r) for r in topk.exact_top_k(frame, F.col("id") % 50 == 0, k=5, scale=256, bucket_rows=3, query_rows=2).select("query_id", "rank", "vec_id", "score").collect())
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    want = Counter()
    for n, (i, q) in enumerate(whole):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(whole) if m != n)[:5]
            want += Counter((i, place, j, -s) for place, (s, j) in enumerate(best, 1))
    assert found == want


def test_targets_are_met_among_equal_rows(spark):
    from scriptorium.llm import mixing
    from scriptorium.llm.common import durable

    rows = [(1, "one two three four five six", "a")] * 1000 + [(i, "word " * (i % 7), "b") for i in range(700)] + [(5, "x y", None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    slim = durable(mixing.keyed(docs))
    decided = mixing.decisions(slim)
    mixed = [r.asDict() for r in mixing.with_copies(slim, decided).collect()]
    assert "tie" not in mixed[0]
    for source in ("a", "b", None):
        own = [r for r in mixed if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6, source
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
    again = [r.asDict() for r in mixing.with_copies(slim, mixing.decisions(slim)).collect()]
    count = lambda rows: Counter((r["doc_id"], r["source"], r["copies"]) for r in rows)
    assert count(mixed) == count(again)


def test_pipeline_without_language_labels_keeps_every_text_with_a_letter(spark):
    import corpus_pipeline

    texts = ["The cat sat on the mat and slept all day.", "Der Hund lief durch den Wald und bellte laut.", None, "", "123 --", "Another text in plain words.", "The cat sat on the mat and slept all day."]
    rows = [(None if i == 0 else i, t, None, "s" if i % 2 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __language string")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, "")
    assert told.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"] or 0, r["text"]) for r in told.collect()) == sorted((r[0] or 0, r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    kept = told
    for name in ("near_dedup", "pii", "mix", "pack"):
        kept = stages[name](spark, kept, "").checkpoint()
        assert kept.count() > 0, name
    assert stages["language_id"](spark, docs.limit(0), "").count() == 0
