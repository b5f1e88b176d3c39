"""Training-data operators against brute force, round trips and edge cases."""

import datetime
import hashlib
import hmac
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import fingerprints, language, licenses, mixing, near_dedup, packing, pii, topk, toxicity, warc
from scriptorium.llm.common import Scratch, durable
from scriptorium.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, id string, n string, part string, range string, `ids` string, copies string, language string, pii_kinds string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


def _rows():
    rng = random.Random(3)
    base = [_text(rng, n) for n in (120, 80, 60, 200, 9, 5, 1, 2, 400)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for i, t in enumerate(base * 3):  # near copies
        w = t.split()
        for _ in range(max(1, len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(w), "de", "s1" if i % 4 else None))
    rows += [(200 + i, base[0], "en", "s0") for i in range(30)]  # exact copies
    rows += [(300, None, None, "s2"), (301, "", "en", None), (302, " \n\t", "en", "s0"), (303, "123 !!", None, "s1"), (304, "ALPHA beta", "en", "s9"), (305, "alpha BETA", "en", "s9"), (None, "no id here", "en", "s0"), (306, "x" * 50_000, "en", "s0")]
    rows += [rows[3], rows[3]]  # repeated rows
    return [(*r, len(r[1] or ""), "a", "b", "c", "d", "e", "f", "g", "h", "i", "j") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return durable(spark.createDataFrame(_rows(), SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_all_pairs(docs, k):
    rows = [(r["doc_id"], _shingles(r["text"], k)) for r in docs.collect() if r["doc_id"] is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = Counter((i, len(s), find(i), find(i) == i) for i, s in rows)
    got = Counter((r["id"], r["n"], r["component"], r["kept"]) for r in near_dedup.near_duplicates(docs, k=k).collect() if r["id"] is not None)
    assert got == want


def test_near_duplicates_of_a_chain_and_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):  # variants that are often unlike each other
        w = list(base)
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: _shingles(t, 2) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r["id"]: r["component"] for r in found} == {i: find(i) for i in sets}


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_components_match_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "EDGES", most)
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(500, i) for i in range(501, 540)] + [(7, 7), (600, 599), (599, 600)]
    root = {x: x for link in links for x in link}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    scratch = Scratch(spark, "test")
    found = near_dedup.components(scratch, spark.createDataFrame(links, "a long, b long").repartition(6)).collect()
    assert sorted((r["node"], r["root"]) for r in found) == sorted((x, y) for x, y in root.items() if x != y)
    assert near_dedup.components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b, c = ("alpha beta gamma delta epsilon " * 3 + x for x in ("one two three", "four five six", "seven"))
    a, b, c = (" ".join(f"{w}{x[-1]}" for w in x.split()) for x in (a, b, c))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, a), (8, None), (8, ""), (9, "")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["id"], r["n"] > 0, r["component"], r["kept"], r["chosen"]) for r in found) == Counter(
        [(3, True, 3, True, True), (5, True, 3, False, False), (5, True, 5, True, True), (7, True, 7, True, True), (7, True, 7, True, False), (None, True, None, True, True), (8, False, 8, True, True), (8, False, 8, True, True), (9, False, 9, True, True)]
    )
    with pytest.raises(ValueError):
        near_dedup.MinMaxSigner(100, 7, 1)


def test_signature_is_unbiased():
    signer = near_dedup.MinMaxSigner(400, 5, 1)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = signer.signature(x[:1000]), signer.signature(x[200:])
    assert abs((a == b).mean() - 800 / 1500) < 0.05


def test_packing_covers_every_id(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.tiktoken"), length=64).collect()
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1])] += 1
    stream = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and 0 <= p["offset"] and p["offset"] + p["length"] <= 64
        for j, x in enumerate(ids):
            at = p["sequence_id"] * 64 + p["offset"] + j
            assert at not in stream
            stream[at] = (p["doc_id"], p["start"] + j, p["doc_tokens"], x)
    assert sorted(stream) == list(range(len(stream)))  # gapless: only the last sequence is padded
    got, at = Counter(), 0
    while at < len(stream):
        doc, start, n, _ = stream[at]
        assert start == 0 and [stream[at + j][1] for j in range(n)] == list(range(n))
        got[doc, tuple(stream[at + j][3] for j in range(n))] += 1
        at += n
    assert got == want


def test_mixing_meets_targets(docs, empty):
    keyed = mixing.keyed(docs)
    slim = durable(keyed.select("doc_id", "source", "size", "key"))
    decided = mixing.decisions(slim)
    rows = mixing.with_copies(slim, decided).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, fixed = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in order}, set()
    while over := [s for s in order if s not in fixed and want[s] > 3 * sizes[s] + 1e-9]:
        fixed |= set(over)
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        for s in order:
            want[s] = 3 * sizes[s] if s in fixed else left * weight[s] / sum(weight[t] for t in order if t not in fixed)
    largest = max(r["size"] for r in rows)
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 3 * largest / 2 + 1  # repeated rows move together
    again = mixing.with_copies(slim, mixing.decisions(slim)).collect()
    assert Counter(rows) == Counter(again)
    none = durable(mixing.keyed(empty).select("source", "size", "key"))
    assert mixing.with_copies(none, mixing.decisions(none)).count() == 0


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10


KEY = b"0123456789abcdef0123"


def _feistel(values, radices, tweak):
    h = len(values) // 2
    left, right, rl, rr = list(values[:h]), list(values[h:]), radices[:h], radices[h:]

    def shifted(half, radix, other, turn):
        message = f"{tweak}|{turn}|{','.join(map(str, other))}"
        stream = "".join(hmac.new(KEY, f"{message}#{b}".encode(), hashlib.sha256).hexdigest() for b in range((len(half) - 1) // 16 + 1))
        return [(v + int(stream[4 * j : 4 * j + 4], 16)) % r for j, (v, r) in enumerate(zip(half, radix))]

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            right = shifted(right, rr, left, i)
        elif h:
            left = shifted(left, rl, right, i)
    return left + right


def test_pseudonyms(spark):
    card, amex = "4111 1111 1111 1111", "378282246310005"
    text = f"mail Ann.b7@x.org, card {card} or {amex}, bad 4111111111111112; +1 (212) 555-0100, 10.0.0.255, 300.1.1.1, 1999-02-28, 1999-02-30, 28.02.1999; 123-45-6789 000-45-6789 DE89370400440532013000 token = \"0123456789abcdef0123456789abcdef\" end. 31/12/1990 02/03/1990 +33 1 23 45 67 89"
    rows = [(1, text, "x"), (2, f"again {card}.", "y"), (3, None, "z"), (4, "", "z"), (5, "plain text", "z"), (6, text.upper(), "z"), (1, text, "x")]
    found = pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string, pii_kinds string"), KEY).collect()
    out = {r["doc_id"]: r["text"] for r in found}
    assert out[3] is None and out[4] == "" and out[5] == "plain text"
    first = out[1]
    for gone in (card, amex, "Ann.b7@", "555-0100", "10.0.0.255", "1999-02-28", "28.02.1999", "123-45-6789", "DE89370400440532013000", "0123456789abcdef0123456789abcdef", "31/12/1990", "02/03/1990", "23 45 67 89"):
        assert gone not in first
    for stays in ("4111111111111112", "300.1.1.1", "1999-02-30", "000-45-6789", "@x.org", "+1 ("):
        assert stays in first
    new = re.search(r"card ([\d ]+) or (\d+),", first)
    assert all(_luhn(x.replace(" ", "")) == 0 for x in new.groups()) and len(new[1]) == len(card)
    assert new[1] in out[2]  # equal values stay linked
    payload = [int(c) for c in card.replace(" ", "")[:-1]]
    assert new[1].replace(" ", "")[:-1] == "".join(map(str, _feistel(payload, [10] * 15, "card:" + ",".join(["10"] * 15))))
    day = (datetime.date(1999, 2, 28) - datetime.date(1900, 1, 1)).days
    a, b = _feistel([day % 17, day // 17], [17, 4297], "date")
    moved = datetime.date(1900, 1, 1) + datetime.timedelta(a + 17 * b)
    assert moved.isoformat() in first and moved.strftime("%d.%m.%Y") in first
    iban = re.search(r"DE(\d{20})", first)[1]
    assert int(iban[2:] + "1314" + iban[:2]) % 97 == 1
    assert out[6].count("@X.ORG") == 1 and "0123456789ABCDEF" not in out[6]
    assert [r["text"] for r in found if r["doc_id"] == 1] == [first, first]


def test_labelled_secrets_are_always_replaced(spark):
    values = ["1234567890123456", "4111111111111112", "AB12CDEF0123456789AB", "4111111111111111", "DE89370400440532", "0123456789abcdef"]
    rows = [(i, f"x token={v} y") for i, v in enumerate(values)] + [(10, "api_key: " + values[2]), (11, 'password="' + values[0] + '"'), (12, values[0] + " and " + values[1])]
    found = {r["doc_id"]: r for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, text in rows[:-1]:
        value = re.search(r"[0-9A-Fa-f]{16,}|DE\d+", text)[0]
        if not value.startswith("DE"):
            assert value not in found[i]["text"] and found[i]["pii_kinds"] == ["secret"] and len(found[i]["text"]) == len(text)
    assert found[12]["text"] == rows[-1][1]  # no label and no valid card
    assert found[0]["text"].split("=")[1].split()[0] == found[11]["text"].split('"')[1]


def test_permutation_is_one_to_one(spark):
    f = pii.Feistel(KEY)
    pairs = spark.range(17 * 40).select(F.array((F.col("id") % 17).cast("int"), F.floor(F.col("id") / 17).cast("int")).alias("v"))
    assert pairs.select(f.permuted(F.col("v"), F.array(F.lit(17), F.lit(40)), F.lit("t")).alias("p")).distinct().count() == 17 * 40


def _plain_fingerprint(text, k=5, w=4):
    """Winnowing word by word with a hash that rolls."""
    import xxhash

    p, base = 2**31 - 1, 1_000_003
    h = []
    for x in re.findall(r"[^\x20\x09-\x0D]+", text.lower()):
        v = xxhash.xxh64_intdigest(x.encode(), seed=42)
        h.append((v - 2**64 if v >= 2**63 else v) % p)
    if not h:
        return []
    rolling = 0
    for v in h[:k]:
        rolling = (rolling * base + v) % p
    grams = [rolling]
    for i in range(k, len(h)):
        rolling = ((rolling - h[i - k] * pow(base, k - 1, p)) * base + h[i]) % p
        grams.append(rolling)
    chosen = []
    for start in range(max(1, len(grams) - w + 1)):
        window = grams[start : start + w]
        place = max(start + n for n, v in enumerate(window) if v == min(window))
        if not chosen or chosen[-1][1] != place:
            chosen.append((grams[place], place))
    return chosen


def _alike(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_match_plain_winnowing(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(2**63 - 1, "the last one of all of them " * 9), (-(2**63), "same same same same same same same same"), (400, "x " * 3000)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, `range` string").repartition(5)
    found = fingerprints.fingerprinted(frame).collect()
    known = sorted((i, t or "") for i, t in rows if i is not None)
    want = Counter()
    for n, (i, text) in enumerate(known):
        want[i, text, known[(n + 1) % len(known)][1]] += 1
    for i, text in rows:
        if i is None:
            want[i, text or "", text or ""] += 1
    assert Counter((r["id"], r["text"], r["next"]["text"]) for r in found) == want
    shown = {(r["id"], r["text"]): r for r in frame.sparkSession.createDataFrame(found, fingerprints.fingerprinted(frame).schema).select(
        "id", "text", fingerprints.as_text(F.col("grams")).alias("f"), F.sha2("edited", 256).alias("sha"), fingerprints.likeness(F.col("grams"), F.col("edited_grams")).alias("near_edited"),
        fingerprints.likeness(F.col("grams"), F.col("next.grams")).alias("near_next")).collect()}
    for r in found:
        text, following = r["text"], r["next"]["text"]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        mine = _plain_fingerprint(text)
        assert [(g >> 31, (2**31 - 1) - (g & (2**31 - 1))) for g in r["grams"]] == mine
        if want[r["id"], text, following] == 1:
            row = shown[r["id"], text]
            assert row["f"] == " ".join(f"{h:x}:{at}" for h, at in mine)
            assert row["sha"] == hashlib.sha256(edited.encode()).hexdigest()
            assert math.isclose(row["near_edited"], _alike(mine, _plain_fingerprint(edited))) and math.isclose(row["near_next"], _alike(mine, _plain_fingerprint(following)))
    assert fingerprints.fingerprinted(empty).count() == 0


def test_ranges_are_even_where_ids_cluster(spark):
    ids = spark.range(40_000).select(F.when(F.col("id") < 39_000, F.col("id")).otherwise(F.col("id") * 10**9).alias("id"), F.lit("t").alias("text"))
    sizes = [r["count"] for r in fingerprints._ranges(ids).groupBy("range").count().collect()]
    assert max(sizes) < 3 * fingerprints.RANGE_ROWS
    assert fingerprints._ranges(ids.select(F.lit(None).cast("long").alias("id"), "text")).where("range >= 0").count() == 0


def test_top_k_matches_all_products(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.1, 3, size=(900, 1))
    x[100:140] = x[7]
    rows = [(i, [float(v) for v in x[i]], "q") for i in range(900)] + [(2000, None, "q"), (2001, [1.0, float("nan")] + [0.0] * 10, "q"), (2002, [None] + [1.0] * 11, "q"), (2003, [float("inf")] * 12, "q"), (2050, [0.0] * 12, "q")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm string")
    found = topk.exact_top_k(frame, F.col("id") % 50 == 0, k=5, bucket_rows=100, query_rows=7).collect()
    ids = list(range(900)) + [2050]
    v = np.vstack([np.floor(256 * x), np.zeros(12)]).astype(np.int64)
    want = []
    for at, i in enumerate(ids):
        if i % 50 == 0:
            scores = sorted((-int(v[at] @ v[j]), ids[j]) for j in range(len(ids)) if j != at)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(want)
    few = topk.exact_top_k(frame.where("vec_id < 3"), F.col("id") % 50 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert topk.exact_top_k(frame.where("vec_id < 0"), F.lit(True)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e7, 2.0]), (1, [3.0, 1e7]), (2, [1e7, 1e7]), (3, [0.5, 0.5]), (4, [-1e7, 3e9]), (5, [1e300, 1.0]), (50, [-1e12, 1e12]), (6, [1e12, 1.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.exact_top_k(frame, F.col("id") % 50 == 0, k=5, bucket_rows=3).collect()
    whole = {i: [max(-(2**62), min(2**62, math.floor(256 * x))) for x in v] for i, v in rows}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(want)


def test_language_sets_match_plain_em():
    rng = random.Random(8)
    p = np.array([[rng.random() ** 3 + 1e-4 for _ in range(4)] for _ in range(language.BUCKETS)])
    model = language.LanguageModel(list("abcd"), p / p.sum(axis=0))
    for text in ("one two three four five", "alpha beta gamma delta " * 40, "ab cd ef gh ij kl mn op qr st uv wx yz"):
        grams = Counter(language.trigrams(text).tolist())
        total = sum(grams.values())

        def fit(kept):
            share = {x: 1 / len(kept) for x in kept}
            for _ in range(4000):
                new = dict.fromkeys(kept, 0.0)
                for g, n in grams.items():
                    mixed = sum(share[x] * model.probability[g][x] for x in kept)
                    for x in kept:
                        new[x] += n * share[x] * model.probability[g][x] / mixed / total
                share = new
            return share, sum(n * math.log(sum(share[x] * model.probability[g][x] for x in kept)) for g, n in grams.items())

        kept = list(range(4))
        share, likelihood = fit(kept)
        while len(kept) > 1:
            fewer = [x for x in kept if x != min(kept, key=lambda x: (share[x], x))]
            share2, likelihood2 = fit(fewer)
            if likelihood2 + 0.5 * 8.0 * math.log(total + 1) < likelihood:
                break
            kept, share, likelihood = fewer, share2, likelihood2
        languages, shares = model.infer(text, 8.0)
        assert sorted(languages) == [model.languages[x] for x in kept]
        assert all(abs(s - share[model.languages.index(x)]) < 0.05 for x, s in zip(languages, shares))


def test_signs_that_are_no_letters():
    model = language.LanguageModel(["aa"], np.full((language.BUCKETS, 1), 1 / language.BUCKETS))
    assert all(model.infer(text, 8.0) == ([], []) for text in ("½²", "①②", "Ⅷ", "12 _ -", "\n\t", "\u0301", None))
    assert all(model.infer(text, 8.0)[0] == ["aa"] for text in ("ª", "你", "a½"))


def test_languages(spark, empty):
    rng = random.Random(1)
    kinds = {"aa": ["babo", "nalu", "komi", "satu"], "bb": ["strepf", "schlag", "krunz", "pfost"], "cc": ["eaux", "oiseau", "rien", "queue"]}
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60))), lang) for i in range(240) for lang, words in [list(kinds.items())[i % 3]]]
    rows = [(j, *r[1:]) for j, r in enumerate(rows)]
    half = " ".join(kinds["aa"] * 30 + kinds["bb"] * 30)
    rows += [(900, half, None), (901, None, "aa"), (902, "", "bb"), (903, "123 !?", "cc"), (904, "babo 你好", None), (None, "babo nalu", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame)
    found = {r["doc_id"]: r["language"] for r in language.with_language(frame, model).collect()}
    assert all(found[i]["prediction"] == lang for i, _, lang in rows[:240])
    assert sorted(found[900]["languages"]) == ["aa", "bb"] and abs(found[900]["score"] - 0.5) < 0.15
    assert all(found[i]["prediction"] == "und" and found[i]["score"] == 0 for i in (901, 902, 903))
    assert language.with_language(empty, language.train(empty)).count() == 0


def test_toxicity_held_out(spark, empty):
    rng = random.Random(2)
    bad = ["grobian", "widerling", "schurke", "halunke"]
    rows, labels = [], []
    for i in range(900):
        w = _text(rng, rng.randrange(40, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "alpha grobian"), (0, rows[0][1])]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    found = toxicity.with_toxicity(docs, model).collect()
    truth = dict(labels)
    held = [(r["toxicity"] >= 0.7) == bool(truth[r["doc_id"]]) for r in found if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(held) / len(held) > 0.95
    assert all(0 <= r["toxicity"] <= 1 for r in found)
    assert all(r["toxicity"] < 0.7 for r in found if r["text"] in (None, ""))
    assert toxicity.train(docs, known.where("toxic = 0")).score("alpha") == 0
    assert toxicity.with_toxicity(empty, toxicity.ToxicityModel()).count() == 0


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a/b c\r\nd", "<p>é</p>"), (2, None, None), (3, "http://x", long), (9, "http://y", long), (4, "http://z", long), (5, "u", "<p>é</p>"), (None, "n", long), (3, "http://x", long), (7, "big", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(pages)
    assert index.count() == len(rows)
    found = warc.read_records(index).collect()
    assert len(found) == len(rows)
    for r in found:
        html = {i: (h or "").encode() for i, _, h in rows}[r["page_id"]]
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha256(html).hexdigest()
        assert r["payload"] == (b"" if r["record_type"] == "revisit" else html)
    kind = {(r["page_id"], r["record_type"], r["refers_to"]) for r in found}
    assert kind == {(1, "response", None), (2, "response", None), (3, "response", None), (9, "revisit", 3), (4, "revisit", 3), (5, "response", None), (None, "response", None), (7, "response", None)}
    one = warc.read_records(warc.selected(index, F.col("page_id") == 7)).collect()
    assert len(one) == 1 and len(one[0]["payload"]) == 3_000_000
    assert warc.read_records(warc.write_archives(pages.where("page_id < 0"))).count() == 0


def test_license_scan(spark):
    rng = random.Random(6)
    rows = [(i, _text(rng, 30) + "\n" + _text(rng, 20)) for i in range(60)]
    rows += [(100, "Intro\nReleased under the MIT License."), (101, "Licensed under CC BY-NC 4.0."), (102, "Her driving license was taken at the border."), (103, None), (104, ""), (101, "Licensed under CC BY-NC 4.0."), (105, "x\n" * 2000 + "This work is licensed under the GNU General Public License, version 3.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(docs, licenses.train(docs)).collect()
    got = Counter((r["doc_id"], r["line"], r["family"]) for r in found)
    assert got == Counter({(100, 1, "MIT"): 1, (101, 0, "CC-BY-NC"): 2, (102, 0, None): 1, (105, 2000, "GPL"): 1})
    assert licenses.scan(docs.where("doc_id < 0"), licenses.train(docs)).count() == 0


def test_edge_rows_do_not_break_the_operators(docs, empty):
    n = docs.count()
    assert pii.pseudonymized(docs, KEY).count() == n
    assert language.with_language(docs, language.train(docs)).count() == n
    assert near_dedup.near_duplicates(docs).count() == n
    assert near_dedup.near_duplicates(empty).count() == 0
    assert packing.pack(empty, tokenizer_file("byte_bpe_50k.tiktoken")).count() == 0
    assert pii.pseudonymized(empty, KEY).count() == 0
