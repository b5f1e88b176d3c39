"""Languages with a small share of a long text."""

import random

import numpy as np

from scriptorium.llm import language

KINDS = {"aa": ["babo", "nalu", "komi", "satu"], "bb": ["strepf", "schlag", "krunz", "pfost"], "cc": ["eaux", "oiseau", "rien", "queue"]}


def _model():
    rng = random.Random(4)
    counts = np.full((language.BUCKETS, 3), 0.5)
    for i, words in enumerate(KINDS.values()):
        counts[:, i] += np.bincount(language.trigrams(" ".join(rng.choice(words) for _ in range(5000))), minlength=language.BUCKETS)
    return language.LanguageModel(list(KINDS), counts / counts.sum(axis=0))


def _text(**words):
    rng = random.Random(7)
    return " ".join(rng.choice(KINDS[lang]) for lang, n in words.items() for _ in range(n))


def test_a_passage_of_one_per_cent_is_found():
    model = _model()
    for n in (60, 200):
        languages, shares = model.infer(_text(aa=20_000, bb=n), 8.0)
        assert languages == ["aa", "bb"]
        grams = len(language.trigrams(_text(aa=20_000))), len(language.trigrams(_text(bb=n)))
        assert abs(shares[1] - grams[1] / sum(grams)) < 0.002 and abs(sum(shares) - 1) < 1e-9


def test_one_language_stays_one():
    assert _model().infer(_text(aa=20_000), 8.0) == (["aa"], [1.0])


def test_shares_are_those_of_greatest_likelihood():
    model, text = _model(), _text(aa=3000, bb=40, cc=1000)
    languages, shares = model.infer(text, 8.0)
    assert sorted(languages) == ["aa", "bb", "cc"]
    p = model.probability[language.trigrams(text)][:, [model.languages.index(x) for x in languages]]
    rng, best = np.random.default_rng(1), np.log(p @ np.array(shares)).sum()
    for _ in range(50):
        other = np.abs(np.array(shares) + rng.normal(0, 0.005, 3))
        assert np.log(p @ (other / other.sum())).sum() <= best + 0.5
