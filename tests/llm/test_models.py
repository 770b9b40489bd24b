"""Language profiles and ordinal regression against plain versions."""

import random
from collections import Counter

import numpy as np
from clauselight.llm import language_id, ordinal


def plain_grams(text):
    counts, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f" {word} "
            counts.update(g for n in (1, 2, 3) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")
            # The space after a word is also the one before the next.
            word = ""
    number = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return {number(g): n for g, n in counts.items()}


def plain_ranking(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language_id.PROFILE]]


def test_languages_agree_with_plain_distances(spark):
    r = random.Random(4)
    alphabets = {"aa": "abcdeéf", "bb": "fghiñ", "cc": "abgHİj", "dd": "日本語ab"}

    def text(lang, words):
        return "".join("".join(r.choices(alphabets[lang], k=r.randint(1, 6))) + r.choice([" ", ", ", "\n", "2"]) for _ in range(words))

    labelled = [(lang, text(lang, 60)) for lang in alphabets for _ in range(5)] + [("aa", None), (None, "x"), ("ee", "12")]
    asked = [text(lang, n) for lang in alphabets for n in (1, 2, 5, 40)] + ["", None, "42", "zzz", text("aa", 20_000), "ab " * 9, "ab " * 9]
    table = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").selectExpr("*", "'aa' AS score")
    got = language_id.identify(table, spark.createDataFrame(labelled, "lang string, text string").repartition(4)).collect()
    places = {}
    for lang in sorted(alphabets):
        whole = Counter()
        for own, t in labelled:
            if own == lang:
                whole.update(plain_grams(t or ""))
        places[lang] = {g: i for i, g in enumerate(plain_ranking(whole))}
    for row in got:
        ranking = plain_ranking(plain_grams(asked[row.doc_id] or ""))
        if not ranking:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        off = {
            lang: sum(abs(own[g] - i) if g in own else language_id.PROFILE for i, g in enumerate(ranking))
            for lang, own in places.items()
        }
        best = min(off, key=lambda lang: (off[lang], lang))  # ties go to the first in order
        assert row.lang_pred == best, (row, off)
        assert abs(row.score - (1 - off[best] / (language_id.PROFILE * len(ranking)))) < 1e-12


def plain_loss(documents, grades, weights, cuts):
    """Penalised negative log-likelihood of cumulative links, one document at a time."""
    total = 0.0
    for found, g in zip(documents, grades):
        score = sum(weights.get(f, 0.0) for f in found.tolist())
        tail = [1.0, *(1 / (1 + np.exp(c - score)) for c in cuts), 0.0]
        total -= np.log(max(tail[g] - tail[g + 1], 1e-9))
    return total / len(grades) + ordinal.PENALTY / 2 * sum(w * w for w in weights.values())


def test_the_fit_minimises_the_plain_loss():
    r = np.random.default_rng(3)
    documents = [np.sort(r.choice(12, r.integers(1, 6), replace=False)).astype(np.int32) for _ in range(400)]
    truth = np.linspace(-2, 2, 12)
    scores = np.array([truth[d].sum() for d in documents]) + r.logistic(size=400)
    grades = np.digitize(scores, [-1.5, 0.5])
    model = ordinal.fit(documents, grades)
    weights = {i: float(model.weights[i]) for i in range(12)}
    cuts = model.thresholds.astype(float)
    best = plain_loss(documents, grades, weights, cuts)
    assert cuts[0] < cuts[1] and best < plain_loss(documents, grades, {}, [-1.5, 0.5]) - 0.1
    assert np.corrcoef(truth, [weights[i] for i in range(12)])[0, 1] > 0.98
    for step in (-0.05, 0.05):
        for i in weights:
            assert plain_loss(documents, grades, weights | {i: weights[i] + step}, cuts) > best - 1e-4
        for i in range(2):
            moved = cuts.copy()
            moved[i] += step
            assert plain_loss(documents, grades, weights, moved) > best - 1e-4
    tails = [model.tails(d) for d in documents[:50]]
    for d, tail in zip(documents, tails):
        score = sum(weights[f] for f in d.tolist())
        assert np.allclose(tail, [1 / (1 + np.exp(c - score)) for c in cuts], atol=1e-5)
