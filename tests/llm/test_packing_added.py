"""Added tokens in texts: the ids of the tokenizer itself."""

import numpy as np
import pytest

from scriptorium.llm import packing
from scriptorium.llm.queries import tokenizer_file

END = "<|endoftext|>"
TEXTS = [f"one {END} two", END, f"{END} at the start", f"at the end {END}", f"at the end  {END}\n\n", f"a{END}{END}b", f" {END} {END} ", f"  \n{END}\t x", "<|endoftext| >", f"<{END}>", "<|endoftext", "no token"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_keeps_added_tokens(tokenizer, text):
    encode = packing.byte_level_encoder(tokenizer_file("byte_bpe_50k.tiktoken"))
    assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_documents_keep_added_tokens(spark, tokenizer):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.tiktoken"), length=1000).collect()
    got = {p["doc_id"]: np.frombuffer(p["ids"], "<u4").tolist() for p in pieces}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
