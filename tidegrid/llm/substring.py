"""Operator 7: repeated passages, found by windows whose length doubles level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, table
from .words import Words, blocks, byte_powers, mix, word_powers


def lengths(words: int) -> list[int]:
    """Window lengths of the levels: halved from ``words`` while it is even, the shortest of 12 words at least."""
    out = [words]
    while out[0] % 2 == 0 and out[0] // 2 >= 12:
        out.insert(0, out[0] // 2)
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n successive values."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _signs(w: Words, length: int, words: int, powers) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``words`` words: the smallest hash of its parts of ``length`` words, and whether it lies in one document."""
    parts, _ = w.windows(length, powers)
    m = len(w.hash) - words + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return _least(parts, words - length + 1)[:m], w.doc[:m] == w.doc[words - 1 :]


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _survey(words: int, length: int):
    """Per document: number of words, digest of all of them, 128-bit print of their sequence, signs of its windows at the first length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp, wp = byte_powers(), word_powers()
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, bounds in blocks(batch.column(2)):
                w = Words(data, bounds, bp)
                sign, whole = _signs(w, length, words, wp)
                rows = []
                for i in range(b - a):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    raw = w.hash[lo:hi].tobytes()
                    parts = data[bounds[i] : bounds[i + 1]].tobytes().split()
                    seen = np.unique(sign[lo : hi - words + 1][whole[lo : hi - words + 1]]).view(np.int64) if hi - lo >= words else np.zeros(0, np.int64)
                    rows.append((hi - lo, _digest(parts), hashlib.blake2b(raw, digest_size=16).digest(), seen))
                n, sha, prints, seen = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha), pa.array(prints, pa.binary()), pa.array(seen, pa.list_(pa.int64()))], ["doc_id", "mark", "n_words", "sha", "print", "signs"])

    return run


def _deepen(words: int, length: int, after: int):
    """Documents with the signs that are repeated at ``length``: the windows that hold one, at length ``after``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp, wp = byte_powers(), word_powers()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hits = batch.column(3)
            for a, b, data, bounds in blocks(batch.column(2)):
                w = Words(data, bounds, bp)
                sign, whole = _signs(w, length, words, wp)
                deep, _ = _signs(w, after, words, wp)
                check = mix(deep ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if after < words else mix(w.windows(words, wp, mix(w.hash + np.uint64(1)))[0])
                out = []
                for i in range(b - a):
                    lo, hi = int(w.first[i]), int(w.first[i + 1]) - words + 1
                    at = np.zeros(0, np.int64)
                    if hi > lo:
                        at = lo + np.flatnonzero(whole[lo:hi] & np.isin(sign[lo:hi], np.asarray(hits[a + i].values).view(np.uint64)))
                    if after < words:
                        out.append((None, np.zeros(0, np.int32), np.unique(deep[at]).view(np.int64), np.zeros(0, np.int32)))
                    else:
                        out.append((press.compress(data[bounds[i] : bounds[i + 1]].tobytes()), (at - lo).astype(np.int32), deep[at].view(np.int64), check[at].astype(np.uint32).view(np.int32)))
                z, pos, h, c = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(z, pa.binary()), pa.array(pos, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.int32()))], ["doc_id", "mark", "z", "at", "h", "c"])

    return run


def _remove(words: int):
    """Documents with the first words of windows that are to go: words removed, digest and text of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, mark, z, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                parts = expand.decompress(z.as_py()).split()
                gone = np.zeros(len(parts) + 1, np.int32)
                first = np.asarray(at.values, np.int64)
                np.add.at(gone, first, 1)
                np.add.at(gone, np.minimum(first + words, len(parts)), -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = [parts[k] for k in np.flatnonzero(keep)]
                rows.append((doc, mark, len(parts) - len(kept), _digest(kept), b" ".join(kept).decode()))
            if rows:
                d, m, n, sha, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(m, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), pa.array(text, pa.string())], ["doc_id", "mark", "n_removed", "kept_sha256", "kept_text"])

    return run


def drop_repeats(docs: DataFrame, words: int = 50) -> DataFrame:
    """Remove every word covered by a window of ``words`` words that also starts in a document of smaller doc_id.

    Windows are judged on the input. Level by level, each window stands for itself by the smallest
    hash among its parts of the level's length; only windows whose sign is repeated in another
    document are extended to twice that length, until the length is ``words`` (a longer repeat is
    made of these, so going on would remove nothing more) or no candidate survives. The first length is ``words`` halved as often
    as it is even, down to 12 words (:func:`lengths`; of 50 that is 25), so that every level doubles into the next and ends at ``words`` exactly.
    Equal windows have equal parts and so equal signs, which is why no repeat is lost; neighbouring windows mostly share their
    smallest part, so that a document sends one sign for about every 13 of its windows, not all of them. Documents equal
    word for word to a smaller one are settled before. A null or empty text has no words; rows that
    repeat a doc_id are judged each by its own text, against texts of smaller ids only, and equal rows give equal rows; a null doc_id is never judged. Other
    columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing went).
    """
    lean(docs.sparkSession)
    row = ["doc_id", "mark"]  # rows of one id are told apart by their texts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("mark"), "text")
    steps = lengths(words)
    seen = cut(docs.mapInArrow(_survey(words, steps[0]), "doc_id long, mark binary, n_words long, sha string, print binary, signs array<long>"), "repeats-survey")
    long = seen.where(F.col("n_words") >= words)
    # what a hot key is joined with is a table of its own, so that Spark can split that key's rows over tasks
    first = cut(long.groupBy("print").agg(F.min("doc_id").alias("first")), "repeats-first")
    judged = cut(long.join(first, "print").select(*row, (F.col("doc_id") > F.col("first")).alias("copy"), F.when(F.col("doc_id") == F.col("first"), F.col("signs")).alias("signs")), "repeats-copies")
    now = judged.where(~F.col("copy")).select(*row, F.explode("signs").alias("h"))
    marks = None
    for length, after in zip(steps, [*steps[1:], words]):
        again = cut(now.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "repeats-again")
        hits = now.join(again, "h").groupBy(*row).agg(F.collect_set("h").alias("hits"))
        found = docs.join(hits, row).select(*row, "text", "hits").mapInArrow(_deepen(words, length, after), "doc_id long, mark binary, z binary, at array<int>, h array<long>, c array<int>")
        deep = cut(found.dropDuplicates(row) if after == words else found, "repeats-level")
        if after == words:
            marks = deep
            break
        now = deep.select(*row, F.explode("h").alias("h"))
        if now.isEmpty():
            break
    out = seen.join(judged.where("copy").select(*row, "copy").distinct(), row, "left")
    none = F.sha2(F.lit(""), 256)
    base = (F.coalesce("copy", F.lit(False)), F.col("n_words"), F.col("sha"))
    if marks is None:
        gone = docs.sparkSession.createDataFrame([], "doc_id long, mark binary, n_removed long, kept_sha256 string, kept_text string")
    else:
        rows = marks.select(*row, F.explode(F.arrays_zip("at", "h", "c")).alias("w")).select(*row, "w.at", "w.h", "w.c")
        least = rows.groupBy("h", "c").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        least = cut(least.select("h", "c", "lo"), "repeats-least")
        bad = rows.join(least, ["h", "c"]).where("doc_id > lo").groupBy(*row).agg(F.collect_set("at").alias("bad"))
        gone = marks.select(*row, "z").join(bad, row).select(*row, "z", "bad").mapInArrow(_remove(words), "doc_id long, mark binary, n_removed long, kept_sha256 string, kept_text string")
    copy, n, sha = base
    return out.join(gone, row, "left").select(
        "doc_id", n.alias("n_words"),
        F.when(copy, n).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, none).otherwise(F.coalesce("kept_sha256", sha)).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), 50).select("doc_id", "n_words", "n_removed", "kept_sha256")
