"""Operator 2: documents packed into sequences by minimum bin slack.

Spark tokenises the documents and counts their pieces by length; there are at most ``capacity`` different
lengths, so the counts are bounded whatever the corpus. On them the driver plans sequence after sequence: the
longest length left, and with it the combination of lengths that fills the rest best, found by subset-sum
dynamic programming over bit sets; the combination is removed as often as its lengths last. Pieces then find
their places in the plan by their rank among the pieces of their length, in Spark.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, lean, table
from .words import spare

CAPACITY = 2048
END = 0
_MARK = "<|"  # what special tokens begin with
_MEMORY = 200_000  # chunks that a worker remembers


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merges of many words at once: in every word the pair of least rank, the leftmost if tied, is merged, until none is left."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        names = _byte_names()
        self.inner = np.array([vocabulary[c] for c in names], np.int64)
        self.last = np.array([vocabulary[c + end] for c in names], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        pairs = np.array([(vocabulary[a] << 16) + vocabulary[b] for a, b in merges], np.uint32)
        self.none = len(merges)
        self.slots = np.full(1 << 18, self.none, np.int64)
        self.pairs = np.append(pairs, np.uint32(0xFFFFFFFF))
        todo, at = np.arange(len(merges)), self._at(pairs)
        while len(todo):  # open addressing; of those that want a free slot the last written has it
            free = self.slots[at] == self.none
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _at(pairs: np.ndarray) -> np.ndarray:
        return ((pairs * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or ``none``; a token -1 is in no pair."""
        key = ((a << 16) + b).astype(np.uint32)
        at = self._at(key)
        out = self.slots[at]
        wrong = np.flatnonzero((out != self.none) & (self.pairs[out] != key))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] != self.none) & (self.pairs[out[wrong]] != key[wrong])]
        out[(a < 0) | (b < 0)] = self.none
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words one after the other, and where each word's end."""
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        letter = data != 32
        ends = np.append(np.flatnonzero(~letter) - np.arange(len(words) - 1), letter.sum())
        data, starts, n = data[letter], np.append(0, ends[:-1]), len(data) - len(words) + 1
        token = np.append(self.inner[data], -1)  # the last stands for what is outside a word
        token[ends - 1] = self.last[data[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[starts] = n, -1
        never = self.none * n
        key = self.rank(token[:n], token[after]) * n + np.arange(n)  # least for the pair to merge
        while True:
            best = np.minimum.reduceat(key, starts)
            best = best[best < never]
            if not len(best):
                return token[token >= 0].astype(np.uint32), np.cumsum(np.add.reduceat((token[:n] >= 0).astype(np.int64), starts))
            at = best % n
            right = after[at]
            token[at], token[right] = self.made[best // n], -1
            key[right] = never + right
            after[at] = after[right]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            key[at] = self.rank(token[at], token[after[at]]) * n + at
            left = before[at]
            at, left = at[left >= 0], left[left >= 0]
            key[left] = self.rank(token[left], token[at]) * n + left


def _byte_names() -> list[str]:
    """The characters by which byte-level vocabularies name bytes: printable ones name themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


# How a tokenizer's file must normalise and split texts for its chunks to be encoded alone.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def suits(path: str) -> bool:
    """Whether :class:`Chunked` gives the ids of the tokenizer in this file: it normalises and splits as stated above, marks the end of words,
    has the bytes and full stop and comma as tokens, and fewer than 65 536 tokens."""
    with open(path) as f:
        made = json.load(f)
    model, steps = made["model"], (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = steps[0] if len(steps) == 2 else {}
    vocabulary, end = model.get("vocab", {}), model.get("end_of_word_suffix")
    return (
        made.get("normalizer") == _NORMALIZER and made.get("truncation") is None and made.get("padding") is None
        and split.get("pattern") == {"Regex": _SPLIT} and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        and all(model.get(k) == v for k, v in _MODEL.items()) and bool(end) and isinstance(vocabulary, dict) and len(vocabulary) < 1 << 16
        and all(c in vocabulary and c + end in vocabulary for c in [*_byte_names(), ".", ","])
        and all(t["content"].startswith(_MARK) for t in made.get("added_tokens", []))
    )


class Whole:
    """Ids of texts by the tokenizer of any file, each text as a whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]


class Chunked:
    """Ids of texts by a lower-casing tokenizer whose tokens never reach over white space or from letters to punctuation (see :func:`suits`).

    Each chunk between white space is encoded once and remembered: words of letters by :class:`Merges`, a word with a full stop or
    comma after it as both, the rest by the tokenizer. Texts with special tokens, with separators that the tokenizer
    doesn't take as white space, or with characters for which lower case may depend on their neighbours, are encoded
    whole by the tokenizer."""

    def __init__(self, path: str, separator: str = "<|endoftext|>") -> None:
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]], model["end_of_word_suffix"])
        self.stops = {c: model["vocab"][c + model["end_of_word_suffix"]] for c in ".,"}
        self.separator, self.mark = separator, self.t.token_to_id(separator)
        self.odd = re.compile("[^\x00-\x1b\x20-\u017f]|" + re.escape(_MARK))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        n = len(self.known)
        self.starts = np.concatenate([self.starts, self.used + ends])
        self.used += len(ids)
        self.known.update(zip(chunks, range(n, n + len(chunks))))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these chunks one after the other, and where each ends."""
        start = self.starts[at]
        n = self.starts[at + 1] - start
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1]) + np.repeat(start - ends + n, n)], ends

    def _learn(self, chunks: set[str]) -> None:
        words, stopped, others = [], [], []
        for c in chunks:
            if c.isalpha():
                words.append(c)
            elif c[-1] in self.stops and c[:-1].isalpha():
                stopped.append(c)
            else:
                others.append(c)
        words += {c[:-1] for c in stopped}.difference(self.known, words)
        if words:
            self._add(words, *self.merges.encode(words))
        for i in range(0, len(others), 2000):
            part = others[i : i + 2000]
            ids = self._ids(self.separator.join(part) + self.separator)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part):
                raise ValueError("a chunk holds the separator")
            self._add(part, ids[ids != self.mark], cuts - np.arange(len(cuts)))
        if stopped:
            ids, ends = self._gather(np.array([self.known[c[:-1]] for c in stopped]))
            self._add(stopped, np.insert(ids, ends, [self.stops[c[-1]] for c in stopped]), ends + np.arange(1, len(ends) + 1))

    def _whole(self, text: str) -> bool:
        if text.isascii():
            return _MARK in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return self.odd.search(text) is not None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > _MEMORY:
            self._forget()
        plain = [None if self._whole(x) else x.lower().split() for x in texts]
        new = set().union(*(x for x in plain if x)).difference(self.known)
        if new:
            self._learn(new)
        known, out = self.known, []
        for text, chunks in zip(texts, plain):
            if chunks is None:
                out.append(self._ids(text))
            elif not chunks:
                out.append(np.zeros(0, np.uint32))
            else:
                out.append(self._gather(np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks)))[0])
        return out


def _pieces(path: str, whole: bool, capacity: int, with_ids: bool):
    """(doc_id, text) to pieces, numbered within the task among those of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Whole(path) if whole else Chunked(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            a, n, texts = 0, batch.num_rows, batch.column(1)
            while a < n:
                block, size = [], 0
                while a + len(block) < n and (size < 1 << 19 or not block):
                    block.append(texts[a + len(block)].as_py() or "")
                    size += len(block[-1])
                docs, rows = batch.column(0).slice(a, len(block)).to_pylist(), []
                for doc, ids in zip(docs, coder.encode(block)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        raw = part.tobytes()
                        rows.append((doc, k, start, len(part), zlib.crc32(raw), task, int(seen[len(part)]), raw if with_ids else None))
                        seen[len(part)] += 1
                a += len(block)
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"])
            spare()
        del coder  # a worker that waits for its next task holds no words
        gc.collect()
        spare()

    return run


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary"


def fullest(first: int, lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination holding ``first`` whose sum is largest within ``capacity``: length -> number.

    Bit s of ``reach`` says that the lengths so far can sum to s; lengths go from long to short, each as often as it
    is left and fits, until the capacity is reached exactly or no length remains."""
    room = capacity - first
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(left[length] - (length == first), room // length)):
            wider = (reach | reach << length) & full
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, Counter({first: 1})
    for length, before in reversed(steps):
        if best and not before >> best & 1:
            out[length] += 1
            best -= length
    return dict(out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack on the numbers of pieces by length: (combination, how many sequences of it)."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        combo = fullest(lengths[0], lengths, left, capacity)
        times = min(left[k] // n for k, n in combo.items())
        for k, n in combo.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((combo, times))
    return out


def _runs(made: list[tuple[dict[int, int], int]]) -> dict[int, list[np.ndarray]]:
    """For each length the runs of its ranks: first rank, number in a sequence, first sequence, offset of the first."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank, sequence = Counter(), 0
    for combo, times in made:
        offset = 0
        for length in sorted(combo, reverse=True):
            out.setdefault(length, []).append((rank[length], combo[length], sequence, offset))
            rank[length] += combo[length] * times
            offset += length * combo[length]
        sequence += times
    return {k: [np.array(c, np.int64) for c in zip(*v)] for k, v in out.items()}


def _place(runs: dict[int, list[np.ndarray]]):
    """Arrow function of (length, rank): sequence and offset there."""

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (lengths, ranks))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            mine = length == k
            first, n, base, start = runs[int(k)]
            i = np.searchsorted(first, rank[mine], "right") - 1
            at = rank[mine] - first[i]
            sequence[mine] = base[i] + at // n[i]
            offset[mine] = start[i] + at % n[i] * k
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) and their places in sequences of at most ``capacity`` tokens.

    Returns doc_id, piece (from 0), start (its document's tokens before it), length, ids_crc32, sequence_id (from 0,
    gapless), offset, and with ``with_ids`` the ids (little-endian, 32 bits each). A document's tokens end with the id 0; only
    longer ones are cut. A null text is empty and so one token; every row is packed, repeated rows and null ids
    too; without documents there are no pieces. Other columns are ignored. ``path``: the file of any tokenizer; where it
    doesn't suit the encoding by chunks (:func:`suits`), whole texts are encoded.
    """
    spark = docs.sparkSession
    lean(spark)
    path = path or tokenizer_path()
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, not suits(path), capacity, with_ids), _PIECES)
    pieces = cut(made if with_ids else made.drop("ids"), "pack-pieces")
    # rank among the pieces of a length = those of earlier tasks + the number within its task; the counts of earlier
    # tasks grow with the input, and so are dealt out and not broadcast
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "pack-counts")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    place = _place(_runs(plan(counts, capacity)))
    ranked = pieces.join(before.drop("n").hint("merge"), ["length", "task"]).withColumn("at", place(F.col("length"), F.col("before") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
