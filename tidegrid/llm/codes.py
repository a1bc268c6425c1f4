"""Operator 12: vectors as codes of product quantisation, their entries found in vantage-point trees.

Components become integers, vectors are cut into equal parts, and each part position has a codebook, refined in rounds of assigning and averaging.
A part's nearest entry is found by branch and bound in a tree over the entries of its position: an entry divides the others into a near and a far
half, and the triangle inequality tells which halves can hold a nearer one, or one as near. Bounds are floating point, rounded so that they never
leave out too much; what counts in the end are distances in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table

_SLACK = 1e-12  # more than the roundings of a square root, a sum and a product
_LEAF = 8
_ROWS = 4096  # vectors that are searched at once


def _squared(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``e``, in whole numbers."""
    d = x[:, None, :] - e[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


@dataclass
class _Node:
    """``entries``: indices of a leaf, in order, or the vantage entry alone; halves with the least and largest distance from it to theirs."""

    entries: np.ndarray
    halves: list[tuple[_Node, float, float]]


class Tree:
    """Vantage-point tree over the entries of a codebook."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._built(np.arange(len(entries)))

    def _built(self, at: np.ndarray) -> _Node:
        if len(at) <= _LEAF:
            return _Node(np.sort(at), [])
        far = _squared(self.entries[at[:1]], self.entries[at])[0].argmax()  # an entry at the rim divides the others best
        rest = np.delete(at, far)
        d = _squared(self.entries[at[far : far + 1]], self.entries[rest])[0]
        order = np.argsort(d, kind="stable")
        halves = []
        for half in np.array_split(order, 2):
            low, high = np.sqrt(float(d[half[0]])), np.sqrt(float(d[half[-1]]))
            halves.append((self._built(rest[half]), low * (1 - _SLACK), high * (1 + _SLACK)))
        return _Node(at[far : far + 1], halves)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, of several the one of lowest index."""
        index, best = np.full(len(x), len(self.entries)), np.full(len(x), np.iinfo(np.int64).max)
        rows = np.arange(len(x))
        self._descend(self.root, x, rows, index, best)
        self._visit(self.root, x, rows, index, best)
        return index, best

    def _meet(self, node: _Node, x: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Compare with the node's entries; squared distances to the first one."""
        d = _squared(x[rows], self.entries[node.entries])
        at = d.argmin(axis=1)
        least, entry = d[np.arange(len(rows)), at], node.entries[at]
        better = (least < best[rows]) | (least == best[rows]) & (entry < index[rows])
        index[rows[better]], best[rows[better]] = entry[better], least[better]
        return d[:, 0]

    def _descend(self, node: _Node, x: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        """One way down for each row, to the half whose distances are like its own, for a first bound."""
        d = self._meet(node, x, rows, index, best)
        if node.halves:
            near = np.sqrt(d.astype(np.float64)) <= (node.halves[0][2] + node.halves[1][1]) / 2
            for half, chosen in zip(node.halves, (near, ~near)):
                if chosen.any():
                    self._descend(half[0], x, rows[chosen], index, best)

    def _visit(self, node: _Node, x: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        """Every node that may hold an entry as near as the one found, or nearer."""
        d = np.sqrt(self._meet(node, x, rows, index, best).astype(np.float64))
        for half, low, high in node.halves:
            least = np.maximum(d * (1 - _SLACK) - high, low - d * (1 + _SLACK))
            may = least <= np.sqrt(best[rows].astype(np.float64)) * (1 + _SLACK)
            if may.any():
                self._visit(half, x, rows[may], index, best)


@dataclass(frozen=True)
class Codebooks:
    """``entries``: part position x entry x component, whole numbers; ``scale`` of the components."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def complete(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def _whole(column: pa.Array, width: int, scale: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(-1, width)


def _found(column: pa.Array, books: Codebooks, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors of a batch, block by block, with their indices and squared distances by part."""
    parts, _, size = books.entries.shape
    for a in range(0, len(column), _ROWS):
        x = _whole(column.slice(a, _ROWS), parts * size, books.scale)
        found = [t.nearest(x[:, i * size : (i + 1) * size]) for i, t in enumerate(trees)]
        yield x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: Codebooks):
    """Of a task's vectors: number and sums of the parts of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, size = books.entries.shape
        trees = [Tree(e) for e in books.entries]
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64)
        for batch in batches:
            for x, index, _ in _found(batch.column(0), books, trees):
                for i in range(parts):
                    n[i] += np.bincount(index[:, i], minlength=k)
                    np.add.at(total[i], index[:, i], x[:, i * size : (i + 1) * size])
        used = np.argwhere(n > 0)
        sums = pa.array([total[i, j].tolist() for i, j in used], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n[n > 0], pa.int64()), sums], ["part", "entry", "n", "sums"])

    return run


def fit(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks after ``rounds`` of assigning all parts to their nearest entries and replacing these by the means of theirs, rounded down.

    They begin as the parts of the ``entries`` (256 at most) rows of smallest ``key``, those without one last, repeated ones by their vectors. None without rows.
    Only vectors that are :func:`complete` count. Vectors of different lengths, of one that ``parts`` doesn't divide, or with components so large that sums of squares
    leave 64 bits are a ValueError. Each round reads ``rows`` once; tasks hand on one row for each entry that they used."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part, so that there are 256 entries at most")
    kept = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(complete(F.col("vector")))
    width = F.size("vector")
    low, high, top = kept.agg(F.min(width), F.max(width), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()
    if low is None:
        return None
    if low != high or low % parts:
        raise ValueError(f"vectors have {low} to {high} components, which are not {parts} equal parts")
    if (low // parts) * (2 * (int(top * scale) + 1)) ** 2 >= 1 << 62:
        raise ValueError(f"components of up to {top} are too large")
    first = kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.floor(np.array([r["vector"] for r in first]) * scale).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        sums = kept.select("vector").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        flat = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        new = books.entries.copy()
        for r in flat.collect():  # as many as the codebooks have components
            new[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
        books = Codebooks(new, scale)
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """``rows`` whose vectors are complete, with ``code`` (index of each part's entry, two hexadecimal digits each) and ``error`` (squared distances, summed over
    parts); columns of these names are replaced, the others stay."""
    rows = rows.drop("code", "error")
    name = free_name(rows, "_vector")
    parts, _, size = books.entries.shape

    @F.arrow_udf("struct<code: string, error: bigint>")
    def search(vectors: pa.Array) -> pa.Array:
        trees, codes, errors = [Tree(e) for e in books.entries], [], []
        for _, index, d in _found(vectors, books, trees):
            codes += [r.tobytes().hex() for r in index.astype(np.uint8)]
            errors.append(d.sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else [], pa.int64())], ["code", "error"])

    kept = rows.withColumn(name, F.col(vector).cast("array<double>")).where(complete(F.col(name)) & (F.size(name) == parts * size))
    return kept.withColumn(name, search(name)).withColumns({"code": F.col(f"{name}.code"), "error": F.col(f"{name}.error")}).drop(name)


def compress(rows: DataFrame, **settings) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of ``rows`` (vec_id, embedding, label).

    ``label_error`` is the sum of the errors of all rows of that label, those without one together. For the codebooks see :func:`fit`. Rows whose
    vector is null, empty, or holds null or non-finite components are left out; repeated rows and null ids stay and count each; other columns are ignored.
    Without rows there are none. Sums by label are made in tasks first, and rows join them as a table, so that a label may hold most rows."""
    own = rows.select("vec_id", "embedding", "label")
    books = fit(own, **settings)
    if books is None:
        return own.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = cut(encode(own, books).drop("embedding"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of").withColumn("codebooks_sha256", F.lit(books.sha256()))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
