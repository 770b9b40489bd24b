"""Near-duplicates, decontamination, language, perplexity and quality against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from clauselight.llm import components, decontamination, language_id, near_dedup, ordinal, perplexity

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def edited(text, n):
    words = text.split()
    for i in random.sample(range(len(words)), n):
        words[i] = random.choice(VOCABULARY)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    passage = prose(60)
    base = prose(120)
    texts = [None, "", " \n ", "one two", "ONE two", "a b c d e", prose(15000)]
    texts += [prose(80) for _ in range(30)] + [base] * 5
    texts += [edited(base, k) for k in (1, 2, 3, 3, 4, 5, 6, 7, 8, 12)]
    texts += [f"{prose(12)} {passage} {prose(8)}" for _ in range(25)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, None, "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, leader long")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_agree_with_all_pairs(spark, corpus):
    sets = {r.doc_id: shingle_set(r.text) for r in corpus.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = near_dedup.near_duplicates(corpus).collect()
    assert len(got) == corpus.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(corpus.filter("false")).count() == 0


def test_components_of_a_path_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(5, 5), (100, 99), (99, 100)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_fm_index_finds_every_occurrence():
    text = np.array([random.randint(1, 4) for _ in range(3000)] + [0])
    index = decontamination.FMIndex(text)
    patterns = np.array([[random.randint(1, 5) for _ in range(4)] for _ in range(60)])
    for pattern, low, high in zip(patterns, *index.search(patterns)):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == pattern).all()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == want


@pytest.fixture
def same_random_texts(block_bytes):
    """Both forms of a test see the same texts, and so do the tests after it."""
    state = random.getstate()
    yield
    if block_bytes == 200:
        random.setstate(state)


@pytest.mark.parametrize("block_bytes", [200, 32 << 20])
def test_leaks_agree_with_brute_force(spark, monkeypatch, block_bytes, same_random_texts):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)  # one block, or several passes
    items = [(i, prose(25)) for i in range(8)] + [(8, "short item"), (9, None), (10, ""), (3, prose(11))]
    items.append((None, " ".join(f"nameless{i}" for i in range(14))))
    rows = [prose(50) + " " + items[1][1].upper() + ", " + prose(3), items[2][1][:60], None, "", "--",
            "a short-item b short item", items[0][1] + " " + items[0][1], "ü " + items[3][1], "x " + items[-1][1]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "'x' AS items", "1 AS _leak0", "2 AS _leak2")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    found = {r.doc_id: r for r in decontamination.find_leaks(docs, benchmark).collect()}
    for i, text in enumerate(rows):
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit |= set(range(at, at + n))
                        names |= {str(name)} - {"None"}
        r = found[i]
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(names)), i
    assert found[len(rows) - 1].n_hit == 14 and found[len(rows) - 1].contaminated
    clean = {r.doc_id: r.text for r in decontamination.remove_leaks(docs, benchmark).collect()}
    assert clean[2] is None and clean[4] == "--" and clean[5] == "a  b "
    assert not any(r.contaminated for r in decontamination.find_leaks(
        decontamination.remove_leaks(docs, benchmark), benchmark).collect())
    assert decontamination.find_leaks(docs, benchmark.filter("false")).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontamination.find_leaks(docs.filter("false"), benchmark).count() == 0


def test_languages_are_told_apart(spark):
    a = ["the cat sat on the mat with the hat", "this and that are then there"] * 3
    b = ["der hund und die katze sind nicht im haus", "ich bin auch mit dem zug"] * 3
    rows = [("en", t) for t in a] + [("de", t) for t in b] + [(None, "x")]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    docs = spark.createDataFrame(
        [(1, "the hat and the cat"), (2, "und der hund"), (3, None), (4, "12 !? ²"), (5, ""), (6, "日本")],
        "doc_id long, text string",
    ).selectExpr("*", "'de' AS lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, labelled).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and 0 < got[1][1] <= 1
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in ("de", "en")
    nothing = language_id.identify(docs, labelled.filter("false")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_model_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([("en", prose(300).encode()), ("en", b"abra cad abra")], "lang string, text binary")
    counts = perplexity.ngram_counts(rows)
    finished = perplexity.kneser_ney(counts)
    letters = sorted({r.gram[-1] for r in counts.collect()})
    unseen = {r.lang: r.value for r in finished.filter("gram = '' AND kind = 'p'").collect()}
    model = perplexity.Model(perplexity.hashed_model(finished).toArrow(), unseen)
    for start in ("", "w", "w1", "abr", "zq"):
        whole = [f"{start}{c}" for c in letters if c != perplexity.END]
        # The chance of each next letter: a longer word's score without its end.
        table = {(r.kind, r.gram): r.value for r in finished.collect()}

        def chance(gram):
            if ("p", gram) in table:
                return table["p", gram]
            if len(gram) == 1:
                return unseen["en"]
            return table.get(("b", gram[:-1]), 0.0) + chance(gram[1:])

        history = (perplexity.START + start)[-3:]
        total = sum(np.exp(chance(history + c)) for c in letters) + np.exp(chance(history + "䑄"))
        assert total == pytest.approx(1, abs=1e-3)
        for word in whole[:5]:
            padded = perplexity.START + word + perplexity.END
            want = sum(chance(padded[max(0, i - 3) : i + 1]) for i in range(1, len(padded)))
            assert model.score("en", [word.encode()])[0][0] == pytest.approx(want, abs=1e-3)


def test_ngrams_of_any_alphabet_are_counted():
    words = {"abra": 3, "ab": 2, "": 1, "".join(map(chr, range(0x10000, 0x30000))): 5}
    padded = [perplexity.START + w + perplexity.END for w in words]
    want = Counter()
    for p, n in zip(padded, words.values()):
        for i in range(1, len(p)):
            want[p[max(0, i - 3) : i + 1]] += n
    codes, place, sizes = perplexity._laid_out(padded)
    assert perplexity._event_counts(codes, place, np.repeat(list(words.values()), sizes)) == want


def test_grams_stay_within_words():
    grams, counts = language_id._gram_counts("  Hallo, wëlt! 12 ²x_y  hallo")
    got = {"".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s): n for g, n in zip(grams.tolist(), counts.tolist())}
    want = Counter()
    for word in ("hallo", "wëlt", "x", "y", "hallo"):
        padded = f" {word} "
        want.update(word)
        want.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    assert got == want


def test_quality_measures_agree_with_plain_python(spark, corpus):
    odd = [(1000, "a b c a b c\n\na b c a b c\n x * # é", None, "s", 0), (1001, "zzz " * 70, "en", "s", 0)]
    docs = corpus.union(spark.createDataFrame(odd, corpus.schema))
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in perplexity.quality(docs).collect()
    )
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.split()]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
              len(lines) - len(set(lines)), len(again), failed)] += 1
    assert got == want
    assert perplexity.quality(docs.filter("false")).count() == 0


def test_gibberish_leaves_the_band(spark):
    rows = [(i, " ".join(random.choices("the of and house garden water people".split(), k=80)), "en") for i in range(60)]
    rows.append((60, " ".join("".join(random.choices("#|~^qxz0987{}[]", k=8)) for _ in range(80)), "en"))
    got = perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r.doc_id for r in got if not r.kept and not r.base_failed] == [60] or not [
        r for r in got if r.doc_id == 60 and r.kept
    ]


def test_bands_reject_on_both_sides(spark):
    rng = random.Random(11)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    words = ["".join(rng.choices(letters, range(26, 0, -1), k=rng.randint(2, 8))) for _ in range(600)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=150)), "en") for i in range(200)]
    rows.append((1000, " ".join(rng.choices(words[:12], k=90)), "en"))
    odd = [w[::-1] for w in rng.choices(words[300:], k=40)] + rng.choices(words, weights, k=60)
    rows.append((1001, " ".join(odd), "en"))
    rows += [(2000 + i, rows[0][1], "en") for i in range(400)]
    got = {r.doc_id: r for r in perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    usual = float(np.median([got[i].log_perplexity for i in range(200)]))
    low, high = got[1000], got[1001]
    assert not low.base_failed and not high.base_failed
    # Both lie within one nat of the median.
    assert usual - 1 < low.log_perplexity < usual < high.log_perplexity < usual + 1
    assert not low.kept and not high.kept
    assert sum(got[i].kept for i in range(200)) > 180


def test_each_ngram_of_the_model_keeps_its_own_probability(spark):
    # So many n-grams that 24 bits can't tell them apart.
    rng = random.Random(3)
    rows = [("x", "".join(map(chr, rng.choices(range(0x4E00, 0x9E00), k=40_000))).encode()), ("x", b"\x02a a\x03b ab \x00")]
    texts = spark.createDataFrame(rows, "lang string, text binary")
    finished = perplexity._stored(perplexity.kneser_ney(perplexity.ngram_counts(texts)), "model").cache()
    table = {(r.lang, r.gram): r.value for r in finished.filter("kind = 'p' AND gram <> ''").collect()}
    assert len(table) == finished.filter("kind = 'p' AND gram <> ''").count() > 80_000
    numbered = texts.selectExpr("CAST(length(text) AS LONG) AS doc_id", "lang", "text")
    one, several = ({r.doc_id: r.log_perplexity for r in perplexity.scored(numbered, finished, n).collect()} for n in (1 << 22, 9_000))
    for _, text in rows:
        total, n = 0.0, 0
        for word in text.split():
            padded = perplexity._padded(word)
            total += sum(table["x", padded[max(0, i - 3) : i + 1]] for i in range(1, len(padded)))
            n += len(padded) - 1
        assert one[len(text)] == pytest.approx(-total / n, rel=1e-9)
        assert several[len(text)] == pytest.approx(-total / n, rel=1e-9)


def test_symbol_laden_documents_are_in_the_model(spark):
    rows = [("md", b"| a | b | # c"), ("en", b"plain words"), ("en", b"# $x$ <b>")]
    counts = perplexity.ngram_counts(spark.createDataFrame(rows, "lang string, text binary")).collect()
    assert {(r.lang, r.gram) for r in counts} >= {("md", "\x02|"), ("md", "\x02a"), ("en", "\x02p"), ("en", "\x02#")}


def test_grades_of_held_out_documents(spark):
    bad, poor = "awful nasty".split(), "buy ### now".split()
    rows, labels = [], []
    for i in range(400):
        words = prose(60).split()
        kind = i % 4
        words[5:7] = bad if kind == 0 else poor if kind == 1 else words[5:7]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").selectExpr("*", "1 AS grade")
    rated = ordinal.graded(spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int"))
    model = ordinal.train(docs, rated.filter("doc_id < 300"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in ordinal.grade(docs, model).collect()}
    right = defaultdict(list)
    for i in range(300, 400):
        right[i % 4].append(got[i].kept == (i % 4 > 1))
        assert got[i].p_1 >= got[i].p_2 and got[i].expected_grade == pytest.approx(got[i].p_1 + got[i].p_2)
    assert min(np.mean(x) for x in right.values()) > 0.7 and len(got) == 402
    kept = {r.doc_id for r in ordinal.select(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert ordinal.grade(docs, ordinal.train(docs, rated.filter("false"))).count() == 402
