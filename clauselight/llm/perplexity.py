"""Quality rules with n-gram perplexity bands per language.

The language model is modified Kneser-Ney of order 4 over the characters of a
word between a start and an end sign. Spark counts the n-grams of all documents
and derives discounts, probabilities and back-off weights. The finished model holds
every n-gram by its characters, no hashes. It grows with the corpus; tasks hold one block
of it at a time, and a document's log-probability is summed over all blocks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselight.llm.words import batch_rows
from clauselight.session import new_path

ORDER = 4
START, END = "\x02", "\x03"
# N-grams of the model that a task holds at a time.
BLOCK_ENTRIES = 1 << 22
# A document is rejected if its log-perplexity is further from the median of its
# language than so many standard deviations (as the quartiles tell them).
LOWER, UPPER = 3.0, 3.0
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # of 100 words
_WORDS_HELD = 200_000
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))


def _padded(word: bytes) -> str:
    text = word.decode("utf-8", "replace")
    # Signs in the text itself are told apart: as white space, which no word holds.
    return START + text.replace(START, "\t").replace(END, "\n") + END


def _event_counts(codes: np.ndarray, place: np.ndarray, times: np.ndarray) -> Counter:
    """N-grams that end at each character after the start: it and what precedes it in the word.

    ``codes`` are the code points of padded words in a row, ``place`` is where in
    its word each one stands and ``times`` how often the word occurs. Up to four
    characters, numbered within the call, make one 64-bit number; if they are too
    many for 16 bits, the words are counted in two halves.
    """
    alphabet = np.flatnonzero(np.bincount(codes))
    if len(alphabet) >= 1 << 16:
        middle = len(codes) // 2
        # The later half sees the characters before it, as context alone.
        back = max(0, middle - ORDER + 1)
        after = times[back:].copy()
        after[: middle - back] = 0
        return _event_counts(codes[:middle], place[:middle], times[:middle]) + _event_counts(
            codes[back:], place[back:], after
        )
    number = np.zeros(0x110000, np.uint64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    numbers = number[codes]
    keys = numbers.copy()
    for i in range(1, ORDER):
        keys[i:] |= np.where(place[i:] >= i, numbers[:-i] << np.uint64(16 * i), np.uint64(0))
    ends = (place > 0) & (times > 0)
    keys, times = keys[ends], times[ends]
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    found, totals = keys[first], np.add.reduceat(times, first) if len(first) else times
    letters = [""] + [chr(c) for c in alphabet.tolist()]
    columns = [((found >> np.uint64(16 * i)) & np.uint64(0xFFFF)).tolist() for i in reversed(range(ORDER))]
    grams = ("".join(map(letters.__getitem__, x)) for x in zip(*columns))
    return Counter(dict(zip(grams, totals.tolist())))


def _laid_out(padded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words in a row, the place of each in its word, and the words' sizes."""
    sizes = np.array([len(p) for p in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4")
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def ngram_counts(documents: DataFrame) -> DataFrame:
    """(lang, gram, n) over all words of (lang, text as bytes)."""

    def count(batches):
        def handed_on():
            rows = []
            for lang, words in held.items():
                codes, place, sizes = _laid_out([_padded(w) for w in words])
                times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
                rows += [(lang, gram, n) for gram, n in _event_counts(codes, place, times).items()]
            held.clear()
            return pa.record_batch(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
                names=["lang", "gram", "n"],
            )

        held: dict[str, Counter] = {}
        for batch in batch_rows(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = text.split() if text else []
                if words:
                    held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) >= _WORDS_HELD:
                yield handed_on()
        if held:
            yield handed_on()

    counts = documents.mapInArrow(count, "lang string, gram string, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _length(column: str = "gram") -> Column:
    return F.char_length(column)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(kind, lang, gram, value): log-probabilities 'p' and log back-off weights 'b'.

    Highest order and n-grams at the start of a word keep their counts; of the
    others counts how many different characters precede them.
    """
    at_start = F.col("gram").startswith(START)
    adjusted = counts
    levels = [counts.filter(_length() == ORDER)]
    for n in range(ORDER - 1, 0, -1):
        above = levels[-1].select("lang", F.substring("gram", 2, n).alias("gram"))
        continued = above.groupBy("lang", "gram").agg(F.count("*").alias("n"))
        # The start sign is never predicted, so it has no unigram.
        levels.append(continued.union(adjusted.filter((_length() == n) & at_start & (n > 1))))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.union(level)
    rows = _stored(rows.select("lang", "gram", "n", _length().alias("size")), "ngram-counts")

    of = lambda i: F.sum(F.when(F.col("n") == i, 1).otherwise(0))
    seen = rows.groupBy("lang", "size").agg(*(of(i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    discount = [
        F.coalesce(
            F.least(F.greatest(F.lit(0.0), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))),
                    F.lit(i - 0.05)),
            F.lit(0.5),
        ).alias(f"d{i}")
        for i in (1, 2, 3)
    ]
    # As tables these have known sizes: n-grams are not shuffled by language to meet them.
    discounts = _stored(seen.select("lang", "size", *discount), "discounts")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    parts = (
        rows.join(discounts, ["lang", "size"])
        .withColumn("d", d)
        .withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    )
    contexts = parts.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("kept_back"))
    parts = parts.join(contexts, ["lang", "context"]).select(
        "lang", "gram", "size", "context",
        ((F.col("n") - F.col("d")) / F.col("total")).alias("own"),
        (F.col("kept_back") / F.col("total")).alias("gamma"),
    )
    parts = _stored(parts, "ngram-parts")
    letters = parts.filter("size = 1").groupBy("lang").agg(F.count("*").alias("letters"))
    letters = _stored(letters, "letters")
    level = parts.filter("size = 1").join(letters, "lang").select(
        "lang", "gram", (F.col("own") + F.col("gamma") / (F.col("letters") + 1)).alias("p")
    )
    done = level
    for n in range(2, ORDER + 1):
        lower = level.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower"))
        level = (
            parts.filter(F.col("size") == n)
            .withColumn("shorter", F.substring("gram", 2, n - 1))
            .join(lower, ["lang", "shorter"])
            .select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
        )
        level = _stored(level, f"ngrams-{n}")
        done = done.union(level)
    # A character never seen has what the unigrams hold back for it.
    unseen = parts.filter("size = 1").groupBy("lang").agg(
        F.max("gamma").alias("gamma"), F.count("*").alias("letters")
    ).select("lang", F.lit("").alias("gram"), (F.col("gamma") / (F.col("letters") + 1)).alias("p"))
    back_off = parts.filter("size > 1").select("lang", F.col("context").alias("gram"), F.col("gamma").alias("p")).distinct()
    log = F.log(F.greatest(F.col("p"), F.lit(1e-12))).cast("float").alias("value")
    return (
        done.union(unseen).select(F.lit("p").alias("kind"), "lang", "gram", log)
        .union(back_off.select(F.lit("b").alias("kind"), "lang", "gram", log))
    )


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# A character is its code point and one; 0 stands for none. Two of them make one number.
_BITS = 21


def scored_grams(finished: DataFrame) -> DataFrame:
    """The model's entries that texts counted into it need: n-grams of full length, at a word's start shorter."""
    full = (_length() == ORDER) | F.col("gram").startswith(START)
    return finished.filter((F.col("kind") == "p") & full)


def hashed_model(finished: DataFrame) -> DataFrame:
    """(kind, lang, before, last, value): n-grams as two numbers of two characters each, the last two in ``last``."""

    def character(from_end: int) -> Column:
        code = F.ascii(F.substring("gram", -from_end, 1)).cast("long") + 1
        return F.when(_length() >= from_end, code).otherwise(F.lit(0).cast("long"))

    def pair(from_end: int) -> Column:
        return F.shiftleft(character(from_end + 1), _BITS).bitwiseOR(character(from_end))

    return finished.filter("gram <> ''").select(
        "kind", "lang", pair(3).alias("before"), pair(1).alias("last"), "value"
    )


def _pairs(characters: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``size`` characters at ``ends``, as ``hashed_model`` writes them."""

    def at(back: int) -> np.ndarray:
        return characters[ends - back] if back < size else np.zeros(len(ends), np.int64)

    return at(3) << _BITS | at(2), at(1) << _BITS | at(0)


class Model:
    """Sorted arrays of log-probabilities and back-off weights by kind and language, or a block of them.

    Pairs of characters are numbered; two numbers are the key of an n-gram, so no two share one.
    """

    def __init__(self, entries: pa.Table, unseen: dict[str, float]):
        self.unseen, self.arrays = unseen, {}
        if not entries.num_rows:
            return
        groups, number = [], np.zeros(entries.num_rows, np.int64)
        for name in ("kind", "lang"):
            column = pa.concat_arrays(entries.column(name).chunks).dictionary_encode()
            groups.append(column.dictionary.to_pylist())
            number = number * len(groups[-1]) + column.indices.to_numpy()
        before, last, values = (entries.column(name).to_numpy() for name in ("before", "last", "value"))
        order = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        for own in np.split(order, starts[1:]):
            kind, lang = divmod(int(number[own[0]]), len(groups[1]))
            pairs = np.unique(np.concatenate([before[own], last[own]]))
            keys = np.searchsorted(pairs, before[own]) << 32 | np.searchsorted(pairs, last[own])
            order_of_keys = np.argsort(keys)
            self.arrays[groups[0][kind], groups[1][lang]] = pairs, keys[order_of_keys], values[own][order_of_keys]

    def _find(self, kind: str, lang: str, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if (kind, lang) not in self.arrays:
            return np.zeros(len(last), bool), np.zeros(len(last), np.float32)
        pairs, have, values = self.arrays[kind, lang]
        first, second = (np.minimum(np.searchsorted(pairs, x), len(pairs) - 1) for x in (before, last))
        keys = first << 32 | second
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return (pairs[first] == before) & (pairs[second] == last) & (have[at] == keys), values[at]

    def score(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probability and number of characters of each word, by a model in one block."""
        codes, place, sizes = _laid_out([_padded(w) for w in words])
        characters, first = codes.astype(np.int64) + 1, np.cumsum(sizes) - sizes
        # From the longest n-gram down: the first one found, plus the back-off on the way.
        value = np.zeros(len(codes))
        waiting = np.flatnonzero(place > 0)
        for size in range(ORDER, 0, -1):
            able = waiting[place[waiting] >= size - 1]
            found, p = self._find("p", lang, *_pairs(characters, able, size))
            value[able[found]] += p[found]
            missed = able[~found]
            if size > 1 and len(missed):
                known, b = self._find("b", lang, *_pairs(characters, missed - 1, size - 1))
                value[missed[known]] += b[known]
            waiting = np.concatenate([waiting[place[waiting] < size - 1], missed])
        value[waiting] += self.unseen.get(lang, np.log(1e-12))
        return np.add.reduceat(value, first), (sizes - 1).astype(np.float64)

    def counted(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The share of this block in the log-probability of words that were counted into the model.

        All their n-grams are in one of the blocks at full length, so none backs off.
        """
        codes, place, sizes = _laid_out([_padded(w) for w in words])
        characters, first = codes.astype(np.int64) + 1, np.cumsum(sizes) - sizes
        value = np.zeros(len(codes))
        for size in range(2, ORDER + 1):
            ends = np.flatnonzero(place >= size - 1 if size == ORDER else place == size - 1)
            found, p = self._find("p", lang, *_pairs(characters, ends, size))
            value[ends[found]] = p[found]
        return np.add.reduceat(value, first), sizes - 1


class _Scorer:
    """Scores of words by language; new words of a slice are scored together."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit, self.known = model, limit, {}

    def sums(self, langs: list[str], documents: list[list[bytes]]) -> list[tuple[float, int]]:
        """Summed log-probability of each document in the model's block, and its characters."""
        for lang in set(langs):
            known = self.known.setdefault(lang, {})
            if len(known) > self.limit:
                known.clear()
            new = list({w for own, d in zip(langs, documents) if own == lang for w in d} - known.keys())
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                known.update(zip(part, zip(*(x.tolist() for x in self.model.counted(lang, part)))))
        out = []
        for lang, words in zip(langs, documents):
            known, p, n = self.known[lang], 0.0, 0
            for value, size in map(known.__getitem__, words):
                p += value
                n += size
            out.append((p, n))
        return out


MEASURES_SCHEMA = (
    "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, log_sum double, n_scored long"
)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    runs = Counter(zip(words, words[1:], words[2:]))
    if len(runs) == max(0, len(words) - 2):
        return 0
    inside = bytearray(len(words))
    for i, run in enumerate(zip(words, words[1:], words[2:])):
        if runs[run] > 1:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def measures(documents: DataFrame, model) -> DataFrame:
    def measure(batches):
        scorer = _Scorer(model.value)
        for batch in batch_rows(batches):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            words = [t.split() for t in texts]
            scores = scorer.sums(batch.column("lang").to_pylist(), words)
            joined = [b"".join(w) for w in words]
            # Bytes that continue a code point are 10xxxxxx.
            points = [len(j) if j.isascii() else len(j.decode("utf-8", "replace")) for j in joined]
            numbers = [
                [len(w) for w in words],
                points,
                [len(t.translate(None, _NOT_SYMBOLS)) for t in texts],
                [_dup_lines(t) for t in texts],
                [_repeat_words(w) for w in words],
            ]
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), batch.column("lang")]
                + [pa.array(x, pa.int64()) for x in numbers]
                + [pa.array([p for p, _ in scores], pa.float64()), pa.array([n for _, n in scores], pa.int64())],
                names=["row", "doc_id", "lang", "n_words", "word_chars", "n_symbols",
                       "n_dup_lines", "n_repeat_words", "log_sum", "n_scored"],
            )

    return documents.mapInArrow(measure, MEASURES_SCHEMA)


def block_sums(documents: DataFrame, model) -> DataFrame:
    """(row, log_sum): what a further block of the model adds to each row."""

    def add(batches):
        scorer = _Scorer(model.value)
        for batch in batch_rows(batches):
            words = [t.split() if t else [] for t in batch.column("text").to_pylist()]
            scores = scorer.sums(batch.column("lang").to_pylist(), words)
            yield pa.record_batch(
                [batch.column("row"), pa.array([p for p, _ in scores], pa.float64())], names=["row", "log_sum"]
            )

    return documents.mapInArrow(add, "row long, log_sum double")


def scored(rows: DataFrame, finished: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Measures and log-perplexity of all rows of (doc_id, lang, text) that were counted into the model.

    The model is sent in blocks, one at a time, any number of them. One block takes one pass over the
    texts; if there are more, texts are numbered and stored once and each takes a pass.
    """
    context = rows.sparkSession.sparkContext
    entries = _stored(hashed_model(scored_grams(finished)), "model-entries")
    blocks = max(1, -(-entries.count() // block_entries))
    if blocks == 1:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    else:
        rows = _stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
        # Dealt out once, not read whole for each block.
        block = F.pmod(F.xxhash64("lang", "before", "last"), F.lit(blocks)).cast("int")
        path = new_path(rows.sparkSession, "model-blocks")
        entries.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(path)
        entries = rows.sparkSession.read.parquet(path)
    measured, more = None, []
    for i in range(blocks):
        own = entries if blocks == 1 else entries.filter(F.col("block") == i).drop("block")
        sent = context.broadcast(Model(own.toArrow(), {}))
        if i == 0:
            measured = _stored(measures(rows, sent), "quality-measures")
        else:
            more.append(_stored(block_sums(rows, sent), "block-sums").withColumn("block", F.lit(i)))
        sent.unpersist()
    if more:
        sums = more[0]
        for part in more[1:]:
            sums = sums.union(part)
        # Added up in the order of blocks: copies of a text get the same sum.
        of = F.sort_array(F.collect_list(F.struct("block", "log_sum")))
        sums = sums.groupBy("row").agg(F.aggregate(of, F.lit(0.0), lambda x, y: x + y["log_sum"]).alias("_more"))
        measured = measured.join(sums, "row").withColumn("log_sum", F.col("log_sum") + F.col("_more")).drop("_more")
    score = F.when(F.col("n_scored") > 0, -F.col("log_sum") / F.col("n_scored"))
    return measured.withColumn("log_perplexity", score).drop("row", "log_sum", "n_scored")


def quality(documents: DataFrame, *, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """Rule measures, log-perplexity and verdict of every row of (doc_id, lang, text).

    ``base_failed``: under 50 words, or over half of the words in repeated
    three-word windows. ``kept``: base passed and the log-perplexity lies in the
    band of the row's language, a null language counting as one of its own. The
    model is made from all rows, the bands from the different scores of rows
    that pass the base rules. A null or empty text has no
    words and fails. Repeated rows are judged each; other columns are not read.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.col("text").cast("binary").alias("text"),
    )
    counts = _stored(ngram_counts(rows.select("lang", "text")), "ngram-events")
    finished = _stored(kneser_ney(counts), "model")
    measured = scored(rows, finished)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    # Scores count once, so that copies of a text don't make the band.
    scores = measured.filter(~failed).select("lang", "log_perplexity").distinct()
    quartiles = scores.groupBy("lang").agg(
        F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000).alias("q")
    )
    deviation = (F.col("q")[2] - F.col("q")[0]) / 1.349
    bands = quartiles.select(
        "lang",
        (F.col("q")[1] - lower * deviation).alias("lowest"),
        (F.col("q")[1] + upper * deviation).alias("highest"),
    )
    # As a table its size is known: measures are not shuffled by language to meet a small one.
    bands = _stored(bands, "bands")
    inside = F.col("log_perplexity").between(F.col("lowest"), F.col("highest"))
    return measured.join(bands, "lang", "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    )
