"""Operator 10: language of whole texts, by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear softmax on that mean gives
the language. Embeddings and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled documents (``per_lang`` documents of each language, fewer where there are more than
``max_langs``, but of every one), whose n-gram counts are made by Spark tasks. For prediction both linear maps are folded
into one table of ``2**bits`` rows of log-odds, looked up for every n-gram of every text.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, lean, table
from .words import blocks, spare

BITS = 16
ORDERS = (2, 3, 4)
_ODD = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
LETTER = r"\p{L}"
UNDECIDED = "und"


def _plain() -> np.ndarray:
    """Byte table: ASCII letters in lower case and bytes of longer characters stay, the rest becomes a space."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    for c in range(97, 123):
        t[c] = t[c - 32] = c
    return t


def grams(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram at each byte, and whether it counts.

    An n-gram counts if it lies in one document and its first two bytes are not both spaces."""
    b = _plain()[data].astype(np.uint32)
    n = len(b)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # bytes up to the document's end
    out = []
    for k in ORDERS:
        if n < k:
            continue
        code = b[: n - k + 1].copy()
        for j in range(1, k):
            code |= b[j : n - k + 1 + j] << np.uint32(8 * j)
        code *= np.uint32(_ODD[k])
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code >>= np.uint32(32 - bits)
        ok = (left[: n - k + 1] >= k) & ((b[: n - k + 1] != 32) | (b[1 : n - k + 2] != 32))
        out.append((code, ok))
    return out


def _counts(bits: int):
    """Texts to their n-gram counts: at most ``2**bits`` buckets, however long the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in blocks(pc.utf8_lower(batch.column(1))):
                rows = []
                made = grams(data, bounds, bits)
                for i in range(b - a):
                    seen = [c[bounds[i] : bounds[i + 1]][ok[bounds[i] : bounds[i + 1]]] for c, ok in made]
                    at, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint32), return_counts=True)
                    rows.append((at.astype(np.int32), n.astype(np.float32)))
                at, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["lang", "at", "n"])

    return run


class Model:
    """Folded log-odds table (a last row of zeros for n-grams that don't count), bias, languages, and the calibration.

    The table's last column is the log-likelihood of an n-gram among those learned; ``usual`` is its mean in texts of each language,
    and a text that falls short of that by more than ``short`` (infinite: not calibrated) is in none of them."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, bits: int, usual: np.ndarray, short: float) -> None:
        self.langs, self.weights, self.bias, self.temperature, self.threshold, self.bits = langs, weights, bias, temperature, threshold, bits
        self.usual, self.short = usual, short


def _shortfall(mean: np.ndarray, n: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """How far a text's mean log-likelihood falls short of its language's, less for one of few n-grams, whose mean varies more."""
    return (usual - mean) / np.sqrt(1 + 200 / np.maximum(n, 1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descend(train: list[tuple[int, np.ndarray, np.ndarray]], k: int, bits: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias after stochastic gradient descent on (number of the language, buckets, shares of the text)."""
    gen = np.random.default_rng(seed)
    emb = gen.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((k, dim), np.float32), np.zeros(k, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in gen.permutation(len(train)):
            y, at, w = train[i]
            rowsof = emb[at]
            h = w @ rowsof
            g = _softmax(out @ h + bias)
            g[y] -= 1
            # an n-gram's share of a text is small, so its embedding takes a step larger by the dimension
            emb[at] = rowsof - (step * 50) * w[:, None] * (g @ out)[None, :]
            out -= step * np.outer(g, h)
            bias -= step * 0.1 * g
    return emb, out, bias


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], bits: int = BITS, dim: int = 16, epochs: int = 6, rate: float = 0.5, keep: float = 0.999, seed: int = 7) -> Model | None:
    """Train on (language, buckets, counts) and calibrate on every eighth row of a language, which is not trained on.

    The temperature minimises the log loss there; the rejection threshold is the confidence that the share
    ``keep`` of these rows reaches, but never above half-way between a guess among all languages and even odds. As that can't
    tell texts of other languages, least of all with one or two learned, a text is also rejected whose n-grams are less likely
    than those of any calibration row by half as much again, and by 0.5 at least. With fewer than 8 such rows nothing is. None without rows.
    """
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    k, number = len(langs), {g: i for i, g in enumerate(langs)}
    data = [(number[g], at, (n / n.sum()).astype(np.float32)) for g, at, n in rows]
    nth, apart = [0] * k, []
    for d in data:
        nth[d[0]] += 1
        apart.append(nth[d[0]] % 8 == 0)
    held = [d for d, out_ in zip(data, apart) if out_]
    train = [d for d, out_ in zip(data, apart) if not out_]
    emb, out, bias = descend(train, k, bits, dim, epochs, rate, seed)
    folded = np.zeros(((1 << bits) + 1, k), np.float32)
    folded[:-1] = emb @ out.T
    seen = np.zeros((k, 1 << bits))
    for y, at, w in train:
        seen[y, at] += w
    likely = np.log(np.mean([(s + 1e-7) / (s.sum() + 1e-7 * len(s)) for s in seen], axis=0))
    folded = np.column_stack([folded, np.append(likely, 0).astype(np.float32)])
    temperature, threshold, short = 1.0, 0.0, np.inf
    usual = np.zeros(k)
    if held:
        z = np.array([w @ folded[at] for _, at, w in held], np.float64)
        z, mean = z[:, :-1] + bias, z[:, -1]
        y = np.array([d[0] for d in held])
        best = np.inf
        for t in np.geomspace(0.05, 20, 61):
            p = _softmax(z / t)[np.arange(len(y)), y]
            loss = float(-np.log(np.maximum(p, 1e-12)).mean())
            if loss < best:
                best, temperature = loss, float(t)
        top = np.sort(_softmax(z / temperature).max(axis=1))
        threshold = float(min(top[int((1 - keep) * len(top))], (1 / k + 0.5) / 2))
        n = np.array([r[2].sum() for r, out_ in zip(rows, apart) if out_])
        said = z.argmax(axis=1)
        usual = np.array([np.average(mean[said == j], weights=np.minimum(n[said == j], 2000)) if (said == j).any() else mean.mean() for j in range(k)])
        if len(held) >= 8:
            short = max(0.5, 1.5 * float(_shortfall(mean, n, usual[said]).max()))
    return Model(langs, folded, bias, temperature, threshold, bits, usual, short)


def train(docs: DataFrame, per_lang: int = 400, max_langs: int = 64, bits: int = BITS, max_grams: int = 8_000_000) -> Model | None:
    """Fit on the labelled documents of smallest id hash of every language: ``per_lang`` of each, or, with more than ``max_langs``
    languages, so many that all have ``per_lang * max_langs`` together, but one at least.

    The whole texts stay in tasks, which make n-gram counts; of these the driver takes ``max_grams`` at most (8 bytes each), dealt out evenly over
    the languages, but one document of each at least, of at most ``2**bits``. The model's table has a column for each language.
    Documents without id, language or letters are never learned from; of rows that share an id that of the smallest text, then language, is.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy("lang").collect()}
    per_lang = min(per_lang, max(1, per_lang * max_langs // max(1, len(counts))))
    # of a language with many documents only the smallest hashes are ranked: over eight times as many as wanted, on average
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    # Arrow tables reach the JVM without a Python worker
    share = known.sparkSession.createDataFrame(pa.table({"lang": pa.array(list(counts), pa.string()), "share": pa.array([min(2**63 - 1, 2**63 * (8 * per_lang + 32) // n) for n in counts.values()], pa.int64())}))
    first = Window.partitionBy("lang").orderBy("at", "doc_id")
    low = known.select("lang", "doc_id", at.alias("at")).join(F.broadcast(share), "lang").where("at <= share")
    picked = low.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_lang)
    chosen = picked.select("doc_id").distinct()  # at most per_lang * max_langs ids, or one of each language
    texts = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("one")).select("doc_id", "one.text", "one.lang").where(F.col("text").rlike(LETTER))
    made = texts.select(F.struct("lang", at.alias("at"), "doc_id").alias("doc"), "text").mapInArrow(_counts(bits), "doc struct<lang: string, at: bigint, doc_id: " + dict(docs.dtypes)["doc_id"] + ">, at array<int>, n array<float>")
    sample = cut(made.select("doc.lang", F.col("doc.at").alias("place"), "doc.doc_id", "at", "n"), "language-sample")
    sizes = sample.select("lang", "place", "doc_id", F.size("at").alias("n")).orderBy("lang", "place", "doc_id").collect()  # as many rows as are chosen
    fits, used = set(), dict.fromkeys(counts, 0)
    for r in sizes:
        if not used[r["lang"]] or used[r["lang"]] + r["n"] <= max_grams // len(counts):
            used[r["lang"]] += r["n"]
            fits.add(r["doc_id"])
    if len(fits) < len(sizes):
        sample = sample.join(F.broadcast(known.sparkSession.createDataFrame([(x,) for x in fits], sample.select("doc_id").schema)), "doc_id")
    rows = [(r["lang"], np.asarray(r["at"], np.int32), np.asarray(r["n"], np.float32)) for r in sample.select("lang", "at", "n").toLocalIterator()]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # the same model whatever order the tasks end in
    np.random.default_rng(11).shuffle(rows)
    model = fit(rows, bits)
    rows.clear()
    gc.collect()
    spare()
    return model


def predictor(spark: SparkSession, model: Model):
    """An Arrow function of a text column: struct of language, calibrated probability, and whether it is rejected."""
    shared = spark.sparkContext.broadcast(model)  # 2**bits rows of one float for each learned language

    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        names, scores, rejected = [], [], []
        lettered = pc.match_substring_regex(texts, LETTER).to_pylist()
        for a, b, data, bounds in blocks(pc.utf8_lower(texts)):
            k = len(m.langs)
            z, n = np.zeros((b - a, k + 1)), np.zeros(b - a)
            full = np.flatnonzero(np.diff(bounds))
            for code, ok in grams(data, bounds, m.bits) if len(full) else []:
                code = np.where(ok, code, np.uint32(1 << m.bits))
                starts = bounds[full]
                live = full[starts < len(code)]
                starts = bounds[live]
                n[live] += np.add.reduceat(ok.astype(np.float64), starts)
                z[live] += np.add.reduceat(m.weights[code], starts, axis=0)
            z /= np.maximum(n, 1)[:, None]
            p = _softmax((z[:, :-1] + m.bias) / m.temperature)
            best = p.argmax(axis=1)
            foreign = _shortfall(z[:, -1], n, m.usual[best]) > m.short
            for i in range(b - a):
                if not lettered[a + i]:
                    names.append(UNDECIDED), scores.append(0.0), rejected.append(True)
                else:
                    s = float(p[i, best[i]])
                    names.append(m.langs[best[i]]), scores.append(s), rejected.append(s < m.threshold or bool(foreign[i]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return predict


def held_out() -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a missing id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, learn_from: DataFrame, **bounds) -> DataFrame:
    """``docs`` with lang_pred, score (calibrated probability, 0 to 1) and rejected.

    Learns from ``learn_from`` (doc_id, text, lang; see :func:`train`). A null text, or one without any letter,
    is ``und`` with score 0 and rejected; a text whose calibrated probability is under the model's threshold, or whose n-grams are
    too unlike those learned (see :func:`fit`), is rejected too, but keeps its most likely language. Without anything to learn from all are ``und``, and only texts without letters are rejected. Every row gives
    one row, repeated rows too; columns of ``docs`` named as the three new ones are replaced, others stay.
    """
    spark = docs.sparkSession
    lean(spark)
    model = train(learn_from, **bounds)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDECIDED), "score": F.lit(0.0), "rejected": F.coalesce(~F.col("text").rlike(LETTER), F.lit(True))})
    out = docs.withColumn("_said", predictor(spark, model)("text"))
    return out.withColumns({c: F.col(f"_said.{c}") for c in ("lang_pred", "score", "rejected")}).drop("_said")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    out = identify(docs.select("doc_id", "held_out", "text"), docs.where(~F.col("held_out")))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
