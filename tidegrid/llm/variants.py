"""Operator 13: words that are spelling variants of more frequent ones, by a rare-first prefix filter of positional bigrams.

A word with an edit loses two of its bigrams at most, so that of the three rarest of each of two near words one is the same, at the
same place or, behind an inserted or deleted letter, at the next one. Words meet only there. As the edit lies on one side of such a bigram,
the other side is equal, and so is one half of the side that holds the edit: both are part of the join's key, so that a
frequent bigram doesn't bring together all words that have it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, table
from .words import Powers, blocks, byte_powers, mix

RARE = 3  # two bigrams touch an edit, and one more
_FLUSH = 1 << 17  # words that a task counts before it hands them on
_LONG = 255  # bytes of the longest run that is hashed together with others


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, without the inversions at its ends."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


def _after(seeds: np.ndarray, longest: int) -> np.ndarray:
    """What the CRCs ``seeds`` add to that of a text of 0, 1, ... ``longest`` bytes that follows: crc(a + b) = this ^ crc(b)."""
    out, step = np.empty((len(seeds), longest + 1), np.uint32), _crc_table()
    out[:, 0] = seeds
    for k in range(longest):
        out[:, k + 1] = (out[:, k] >> np.uint32(8)) ^ step[out[:, k] & np.uint32(255)]
    return out


class Runs:
    """Maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of a block of UTF-8, A-Z in lower case: byte offsets, document, length, hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, powers: Powers) -> None:
        upper = (data >= 65) & (data <= 90)
        self.data = data = np.where(upper, data + np.uint8(32), data).astype(np.uint8)
        letter = (data >= 97) & (data <= 122)
        two = np.flatnonzero(data == 0xC3)  # leads U+00C0 to U+00FF, and nothing else
        letter[two] = letter[two + 1] = True
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = bounds[1:-1]  # a run may reach over the end of a text
        split = inner[(inner > 0) & (inner < len(data))]
        split = split[letter[split] & letter[split - 1]]
        self.start, self.end = np.union1d(start, split), np.union1d(end, split)
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        self.size = self.end - self.start
        up, down = powers.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * up[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + self.size.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _shortened(word: bytes, crc: int) -> bytes:
    """The word without the code point at its CRC modulo its length."""
    text = word.decode()
    k = crc % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def _counts(modulus: int):
    """Words with their numbers, from texts; of runs whose CRC ``modulus`` divides, a letter is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, found = byte_powers(), {}

        def out() -> pa.RecordBatch:
            words, n = pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays([words.cast(pa.string()), n], ["word", "n"])

        for batch in batches:
            seeds = np.array([zlib.crc32(f"{x or ''}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            for a, b, data, bounds in blocks(batch.column(1), 1 << 19):
                r = Runs(data, bounds, powers)
                if not len(r.start):
                    continue
                _, first, which = np.unique(r.hash, return_index=True, return_inverse=True)
                words = [r.word(i) for i in first]
                crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
                short = r.size <= _LONG
                h = np.zeros(len(r.size), np.uint32)
                own = _after(seeds[a:b], int(r.size[short].max(initial=0)))
                h[short] = own[r.doc[short], r.size[short]] ^ crc[which[short]]
                for i in np.flatnonzero(~short):
                    h[i] = zlib.crc32(words[which[i]], int(seeds[a + r.doc[i]]))
                hit = h % np.uint32(modulus) == 0
                for w, n in zip(words, np.bincount(which[~hit], minlength=len(words)).tolist()):
                    if n:
                        found[w] = found.get(w, 0) + n
                for i in np.flatnonzero(hit):
                    w = _shortened(words[which[i]], int(h[i]))
                    found[w] = found.get(w, 0) + 1
                if len(found) >= _FLUSH:
                    yield out()
        yield out()

    return run


def count_words(docs: DataFrame, shortest: int = 5, least: int = 3, modulus: int = 97) -> DataFrame:
    """word, n of the words of at least ``shortest`` code points and ``least`` occurrences in all texts of ``docs`` (doc_id, text).

    Each task adds up its words before they are shuffled, so that a frequent word is one row of a task."""
    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counts(modulus), "word string, n long")
    return counts.where(F.char_length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))


def _keys(text: str, at: list[int]) -> tuple[list[int], list[int]]:
    """Where a word meets others with its bigrams at these places: as the first of two words, and as the second.

    Two words of equal length meet at (0, ...), a word and one that is a letter longer at (1, ...)."""
    size = len(text)
    first, second = [], []

    def key(kind: int, longer: int, p: int, side: int, half: int, gram: str, same: str, part: str) -> int:
        return xxhash.xxh3_64_intdigest(f"{kind} {longer} {p} {side} {half} {gram} {same} {part}") - (1 << 63)

    for p in at:
        gram = text[p : p + 2]
        for side, changed, same in ((0, text[:p], text[p + 2 :]), (1, text[p + 2 :], text[:p])):
            k = len(changed) // 2
            halves = [(0, changed[:k])] + ([(1, changed[k:])] if k else [])
            for half, part in halves:
                first.append(key(1, size + 1, p, side, half, gram, same, part))  # the longer one has its letter in the other half
                if changed:
                    x = key(0, size, p, side, half, gram, same, part)
                    first.append(x), second.append(x)
            if changed:
                k, q = (len(changed) - 1) // 2, p if side else p - 1  # where the shorter one has the bigram
                second.append(key(1, size, q, side, 0, gram, same, changed[:k]))
                if k:
                    second.append(key(1, size, q, side, 1, gram, same, changed[k + 1 :]))
    return first, second


def _meeting_points(frequency: dict[str, int]):
    """Words with the keys of their three rarest bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [], []
            for w in batch.column(0).to_pylist():
                at = sorted(range(len(w) - 1), key=lambda p: (frequency[w[p : p + 2]], w[p : p + 2], p))[:RARE]
                a, b = _keys(w, at)
                one.append(a), two.append(b)
            keys = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(one, keys), pa.array(two, keys)], ["word", "n", "one", "two"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """a, an, b, bn: each two of ``words`` (word, n; distinct, of 4 letters at least) that differ by one inserted, deleted or replaced code point, once.

    Bigrams are ordered by their number in all words, then by themselves, then by place. There are at most as many as pairs of letters, 8100,
    which is what the driver and every task hold. Verified by edit distance."""
    grams = words.select(F.explode(_bigrams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    frequency = {r["gram"]: r["k"] for r in grams.collect()}
    met = cut(words.select("word", "n").mapInArrow(_meeting_points(frequency), "word string, n long, one array<long>, two array<long>"), "variants-keys")
    one = met.select(F.col("word").alias("a"), F.col("n").alias("an"), F.explode("one").alias("key"))
    two = met.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.explode("two").alias("key"))
    longer = F.char_length("b") - F.char_length("a")
    close = ((longer == 1) | (longer == 0) & (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return one.join(two, "key").where(close).select("a", "an", "b", "bn").distinct()


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the links word -> form end. Pointers double in each round, and a form has at least twice its word's number,
    so that there are as many rounds as the logarithm of a logarithm of the largest number."""
    now = cut(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = cut(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "variants-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, factor: int = 2, modulus: int = 97) -> DataFrame:
    """Each word of the texts with its form: word, n, n_near, form, form_n, root.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; of a run whose CRC-32 with its document's id before it is a multiple of
    ``modulus``, the code point at that CRC modulo its length is dropped. Those of ``shortest`` code points (5 at least) and ``least`` occurrences in all texts are
    compared. Near words differ by exactly one code point; ``n_near`` is their number. The form is the near word of largest n (the smallest in code-point order of
    several) where its n is ``factor`` (2 at least) times the word's or more, else null with form_n; the root is where forms lead, the word itself without any.

    A null or empty text has no words, a null id counts as an empty one, repeated rows count each, other columns are ignored. An empty table gives no rows."""
    if shortest < 5 or factor < 2:
        raise ValueError("words of fewer than 5 letters have too few bigrams, and forms need twice a word's occurrences")
    lean(docs.sparkSession)
    words = cut(count_words(docs, shortest, least, modulus), "variants-words")
    pairs = near_words(words)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("k")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("k")))).alias("s"))
    best = sides.groupBy("s.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("s.k")).alias("minus"), F.col("s.near").alias("near"))).alias("top"))
    ahead = -F.col("top.minus") >= factor * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ahead, F.col("top.near")).alias("form"), F.when(ahead, -F.col("top.minus")).alias("form_n"))
    out = cut(out, "variants-forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
