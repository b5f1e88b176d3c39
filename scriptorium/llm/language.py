"""Language identification as a mixture of languages, inferred per document by expectation-maximisation.

Training counts hashed letter trigrams per language over labelled documents. For a document, EM estimates the share of
each language in its trigrams; languages are then removed, smallest share first, while the penalised likelihood
(BIC-like: half of `penalty` * ln(trigrams) for each language) does not fall. What remains is the language set; the
prediction is its largest share. No share is too small as such: EM runs to convergence, and the penalty alone decides.

Scale. One pass counts labelled rows per language; at most about `sample` rows a language, chosen by a hash of the id,
are used for training, so the cost of training is bounded (parameter `sample`). The model is buckets * languages
floats, and goes to the executors with the function. Prediction is a map over whole texts.

Edge cases. Null text, or text without a letter (Unicode category L): `und`, score 0, empty set. A very long text is one array of
trigram numbers. A column of the input named like the added one is replaced. Without any training row every text is `und`.
Texts of unknown trigrams are decided by the smoothed model. Repeated rows get equal results. Ties go to the language
first in order. A null id is never learned from and is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
_NOT_LETTERS = regex.compile(r"\P{L}+")


def held_out(id_col: str) -> Column:
    """Rows whose crc32(id as text) mod 3 is 1: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    """Whether a text has a letter (Unicode category L): what tells a text without a language from one that a model without languages cannot tell."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket numbers of the letter trigrams of a lower-cased text; words are set off by one blank."""
    clean = _NOT_LETTERS.sub(" ", text.lower()) if text else ""
    if clean.isspace() or not clean:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {clean.strip()} ".encode("utf-32-le"), np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    probability: np.ndarray  # buckets x languages

    def infer(self, text: str | None, penalty: float, exact: float = 0.01) -> tuple[list[str], list[float]]:
        """The languages of a text and their shares, largest first; two empty lists without a letter.

        EM runs until the log likelihood is within `exact` of the penalty of one language from its maximum.
        """
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return [], []
        ids, count = np.unique(grams, return_counts=True)
        p = np.ascontiguousarray(self.probability[ids].T)
        total = float(count.sum())
        cost = 0.5 * penalty * np.log(total + 1)

        def fit(of: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
            if len(of) == 1:
                return np.ones(1), float(np.log(p[of[0]]) @ count)
            q = p[of]
            mixed = share @ q
            gain = q @ (count / mixed) / total
            # The likelihood is concave: no mixture is better by more than this.
            while total * np.log(gain.max()) > exact * cost:
                before, share = share, share * gain / (share @ gain)
                if np.array_equal(before, share):
                    break
                mixed = share @ q
                gain = q @ (count / mixed) / total
            return share, float(np.log(mixed) @ count)

        kept = np.arange(len(self.languages))
        share, likelihood = fit(kept, np.full(len(kept), 1 / len(kept)))
        while len(kept) > 1:
            least = share.argmin()
            fewer, start = np.delete(kept, least), np.maximum(np.delete(share, least), 1e-4)
            share2, likelihood2 = fit(fewer, start / start.sum())
            if likelihood2 + cost < likelihood:
                break
            kept, share, likelihood = fewer, share2, likelihood2
        order = np.argsort(-share, kind="stable")
        return [self.languages[kept[i]] for i in order], [float(share[i]) for i in order]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 20_000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows that are not held out and have a language, about `sample` a language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not known:
        return LanguageModel([], np.empty((BUCKETS, 0)))
    share = F.lit(0.0)
    for lang, n in known.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    rows = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                found[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(known)
    place = {lang: i for i, lang in enumerate(languages)}
    matrix = np.full((BUCKETS, len(languages)), smoothing)
    for r in counts.toLocalIterator():  # at most BUCKETS rows a language
        matrix[r["bucket"], place[r["lang"]]] += r["n"]
    return LanguageModel(languages, matrix / matrix.sum(axis=0))


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = 8.0, name: str = "language") -> DataFrame:
    """docs with the struct column `name`: prediction, score, languages and shares."""
    kind = "prediction string, score double, languages array<string>, shares array<double>"

    @F.pandas_udf(kind)
    def infer(texts):
        import pandas as pd

        found = [model.infer(text, penalty) for text in texts]
        return pd.DataFrame({"prediction": [x[0][0] if x[0] else "und" for x in found], "score": [x[1][0] if x[1] else 0.0 for x in found], "languages": [x[0] for x in found], "shares": [x[1] for x in found]})

    return docs.withColumn(name, infer.asNondeterministic()(F.col(text_col).cast("string")))
