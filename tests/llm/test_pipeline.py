"""The pipeline against a plain version of its stages, and the encoder against the tokenizer it stands for."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from scriptorium.llm import packing
from scriptorium.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), before.schema)
        assert docs.columns == before.columns
        kept[name] = docs.collect()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"] for r in kept["language_id"]} == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [r["text"].lower().split()] for i in range(max(1, len(w) - 4))} for r in kept["language_id"]}
    stay = {r["doc_id"] for r in kept["near_dedup"]}
    for i in sets:
        near = [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert i in stay or near
    for i in stay:
        assert not [j for j in stay if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {r["doc_id"] for r in kept["pii"]} == stay
    assert all("@mail" not in r["text"] or r["text"] != texts[r["doc_id"]] for r in kept["pii"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert whole == sum(r["length"] for r in packed)
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in kept["mix"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoder_gives_the_tokenizer_ids(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    encode = packing.byte_level_encoder(tokenizer_file("byte_bpe_50k.tiktoken"))
    assert list(np.array(encode(text))) == tok.encode(text, add_special_tokens=False).ids
