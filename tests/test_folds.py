"""The fold over near duplicates, in one piece and over many partitions."""

import random

import pytest

from scriptorium.operators import merging


def _plain(rows, look_back=5, threshold=0.82):
    grams = lambda t: {t} if 0 < len(t) <= 2 else {t[i : i + 2] for i in range(len(t) - 1)}
    clean = lambda t: "".join(c for c in (t or "") if c.isalnum() or c == "_").lower()
    out = {}
    for group in {g for g, _, _ in rows}:
        kept = []
        for o, t in sorted((o, clean(t)) for g, o, t in rows if g == group):
            a = grams(t)
            found = next((k for k, b in reversed(kept[-look_back:]) if a and b and len(a & b) / len(a | b) >= threshold), None)
            if found is None:
                kept.append((o, a))
            out[group, o] = o if found is None else found
    return out


@pytest.mark.parametrize("parts", [1, 7, 23])
def test_one_large_group_is_folded_in_pieces(spark, parts):
    rng = random.Random(parts)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    base = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
    # Long runs that merge into rows of earlier pieces: what a piece keeps depends on what comes before it.
    rows = [(1, i, base[(i // 40) % 6 if rng.random() < 0.9 else rng.randrange(6)] + rng.choice(["", " x", " alpha"])) for i in range(1500)]
    rows += [(g, i, rng.choice(base)) for g in (2, 3, None) for i in range(5)] + [(4, 0, None), (4, 1, ""), (4, 2, "ab"), (4, 3, "AB!")]
    frame = spark.createDataFrame(rows, "b long, o long, t string").repartition(4)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = {(r["b"], r["o"]): r["merged_into"] for r in merging.folded_near_duplicates(frame, "b", "o", "t").collect()}
        assert merging.folded_near_duplicates(frame.limit(0), "b", "o", "t").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert found == _plain(rows)
