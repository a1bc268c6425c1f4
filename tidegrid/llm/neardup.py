"""Operator 8: near copies by BagMinHash signatures of word-shingle bags, banded and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import connected, cut, lean, table
from .words import Words, blocks, byte_powers, mix, word_powers

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(w: Words, shingle: int, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of each distinct shingle; a text of fewer words is one shingle."""
    h, whole = w.windows(shingle, powers)
    doc, h = w.doc[: len(h)][whole], h[whole]
    few = np.flatnonzero((w.count > 0) & (w.count < shingle))
    if len(few):
        short = np.array([int.from_bytes(hashlib.blake2b(w.hash[w.first[i] : w.first[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in few], np.uint64)
        doc, h = np.concatenate([doc, few]), np.concatenate([h, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """BagMinHash of weighted sets: for each document ``slots`` values that two documents share with
    probability equal to their weighted Jaccard similarity, and whether it has any item.

    The weights, here counts, are discretised into the cells [0, 1), [1, 2), [2, 4), [4, 8), ... Each cell of
    an item has a Poisson process of points whose rate is the cell's width; a point falls on a level of
    its cell (halved down the bits of a hash) and counts where the level is under the weight, and it
    falls on one slot. A slot keeps its earliest point. Only points before a document's horizon are made;
    where a slot is still empty then, the horizon is doubled, which changes no earlier point.
    """
    out = np.zeros((n_docs, slots), np.uint64)
    has = np.bincount(doc, minlength=n_docs) > 0
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    left = has.copy()
    horizon = slots * (np.log(slots) + 3) / np.maximum(total, 1)
    levels = max(1, int(np.max(weight, initial=1) - 1).bit_length() + 1)
    cells = [(np.flatnonzero(weight > (0 if j == 0 else 1 << (j - 1))), j) for j in range(levels)]
    entry = np.concatenate([e for e, _ in cells])
    low = np.concatenate([np.full(len(e), 0 if j == 0 else 1 << (j - 1), np.int64) for e, j in cells])
    rate = np.maximum(low, 1).astype(np.float64)
    owner = doc[entry]
    seed = mix(item[entry] + _GOLD * (low.astype(np.uint64) + np.uint64(1)))
    while left.any():
        live = np.flatnonzero(left[owner])
        t, i, step = np.zeros(len(live)), 0, 1
        found = []
        while len(live):
            points = mix(seed[live][:, None] + _GOLD * np.arange(i + 1, i + step + 1, dtype=np.uint64)[None, :])
            times = t[:, None] + np.cumsum(-np.log(_unit(points)), axis=1) / rate[live][:, None]
            inside = times <= horizon[owner[live]][:, None]
            r, c = np.nonzero(inside)
            p = mix(points[r, c] ^ np.uint64(0x5851F42D4C957F2D))
            level = low[live[r]] + (_unit(mix(p)) * rate[live[r]]).astype(np.int64)
            ok = level < weight[entry[live[r]]]
            found.append((owner[live[r]][ok], (p[ok] >> np.uint64(33)).astype(np.int64) % slots, times[r, c][ok], points[r, c][ok]))
            more = inside[:, -1]
            live, t, i = live[more], times[more, -1], i + step
            step = min(2 * step, 256)
        d, s, when, who = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((who, when, d * slots + s))
        cell = (d * slots + s)[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[first]] = who[order][first]
        full = np.bincount(cell[first] // slots, minlength=n_docs) == slots
        left &= ~full
        horizon = np.where(left, 2 * horizon, horizon)
    return out, has


BITS = 2048


def bitmaps(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document ``BITS`` bits as 64-bit words: each unit of each item's weight turns one bit over.

    The bits in which two documents differ are at most the units that they don't share."""
    at = np.repeat(np.arange(len(doc)), weight)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
    bit = mix(item[at] + _GOLD * copy.astype(np.uint64)) >> np.uint64(65 - BITS.bit_length())
    odd = np.bincount(doc[at] * BITS + bit.astype(np.int64), minlength=n_docs * BITS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n_docs, BITS // 64)


def apart(x: str, y: str) -> Column:
    """Number of bits in which the bitmaps ``x`` and ``y`` differ."""
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))))
    return out


def could_link(x: str, y: str, similarity: float) -> Column:
    """Whether the weights ``n`` and bitmaps of two documents leave room for a link: shared weight of at least
    similarity / (1 + similarity) of the sum, where twice the shared weight is at most the sum less the differing bits."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (both - apart(f"{x}.bits", f"{y}.bits")) / 2 >= similarity / (1 + similarity) * both - 1e-6


def _print(w: Words, i: int) -> bytes:
    """128 bits for the words of a document."""
    return hashlib.blake2b(w.hash[w.first[i] : w.first[i + 1]].tobytes(), digest_size=16).digest()


def _sketch(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp, wp = byte_powers(), word_powers()
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1)):
                w = Words(data, bounds, bp)
                sig, has = signatures(*bags(w, shingle, wp), b - a, bands * rows)
                key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
                key = np.broadcast_to(key, (b - a, bands))
                for k in range(rows):
                    key = mix(key ^ sig[:, k::rows])
                prints = [_print(w, i) if has[i] else None for i in range(b - a)]
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(prints, pa.binary()), arrays], ["doc_id", "print", "bands"])

    return run


def _pack(shingle: int):
    """Texts to their packed form, the weight of their bag and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp, wp = byte_powers(), word_powers()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1)):
                bag = bags(Words(data, bounds, bp), shingle, wp)
                n = np.bincount(bag[0], weights=bag[2], minlength=b - a).astype(np.int64)
                z = [press.compress(data[bounds[i] : bounds[i + 1]].tobytes()) for i in range(b - a)]
                bits = pa.FixedSizeListArray.from_arrays(pa.array(bitmaps(*bag, b - a).reshape(-1)), BITS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(z, pa.binary()), pa.array(n), bits], ["id", "z", "n", "bits"])

    return run


def _overlap(shingle: int):
    """Pairs a, b with both packed texts: the weighted Jaccard similarity of their bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp, wp = byte_powers(), word_powers()
        expand = zstandard.ZstdDecompressor()
        last: tuple = (None, None, None)

        def bag(z: bytes) -> tuple[np.ndarray, np.ndarray]:
            text = np.frombuffer(expand.decompress(z), np.uint8)
            _, h, n = bags(Words(text, np.array([0, len(text)]), bp), shingle, wp)
            return h, n

        for batch in batches:
            sim = []
            for a, za, zb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != a:
                    last = (a, *bag(za.as_py()))
                h, n = bag(zb.as_py())
                both, i, j = np.intersect1d(last[1], h, assume_unique=True, return_indices=True)
                common = int(np.minimum(last[2][i], n[j]).sum()) if len(both) else 0
                sim.append(common / max(1, int(last[2].sum() + n.sum()) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    return run


def _shingles(shingle: int):
    """Packed texts to their bags: one row for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp, wp = byte_powers(), word_powers()
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = np.frombuffer(expand.decompress(z.as_py()), np.uint8)
                _, h, n = bags(Words(text, np.array([0, len(text)]), bp), shingle, wp)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc, np.int64)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["id", "h", "c"])

    return run


def _printed():
    """Rows of (any, text) to the print of the text's words and the text; texts without words give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp = byte_powers()
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1)):
                w = Words(data, bounds, bp)
                has = np.flatnonzero(w.count > 0)
                prints = [_print(w, i) for i in has]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), batch.column(1).slice(a, b - a).take(pa.array(has, pa.int64()))], ["print", "text"])

    return run


def _crossing(left: DataFrame, similarity: float, share: int = 256) -> DataFrame:
    """Pairs a < b of one bucket but different classes that could link, each once; ``left``: key, id, class, n, bits.

    The bound on the overlap is a condition of the join, so that pairs that can't link are never made. A bucket of many members is
    dealt out: its members to salts of about ``share`` on one side, to all salts on the other."""
    keys = left.groupBy("id").agg(F.collect_list("key").alias("keys"))  # at most one for each band
    salts = cut(left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(share)).cast("int").alias("salts")), "near-salts")
    rows = cut(left.join(keys, "id").join(salts, "key"), "near-crossing")
    l = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).alias("l")  # noqa: E741
    r = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("r")
    crossing = (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.class") != F.col("r.class"))
    once = F.array_min(F.array_intersect("l.keys", "r.keys")) == F.col("l.key")  # of the buckets that a pair shares, in one
    return l.join(r, crossing & could_link("l", "r", similarity) & once).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """Class of each document under the links of weighted Jaccard ``similarity`` between bags of word shingles.

    Texts equal word for word are collapsed first; BagMinHash signatures of the rest are cut into bands
    (a pair at 0.8 misses all 24 bands of 4 rows with probability 3e-6). Candidates share a bucket; those that weights and
    bitmaps of their bags leave room for a link are verified on the bags, so that no bucket is expanded into its pairs:
    first each member with the bucket's smallest id, then, in buckets that still hold several classes, with one that
    has the smallest share of private shingles (a group's original, where there is one), and then members of
    different classes with each other. Before the last two, members are set aside that can't link to anyone there: weight
    of shingles that no other such document has can't be shared, and what is left is too little for the
    smallest member of the bucket. So no candidate link between classes is lost. The work of a large
    bucket is dealt out by salts.

    A null or wordless text is a class of its own; repeated rows of a doc_id give one row. A doc_id that stands with several
    texts is linked to whatever any of them is, and all of them are in its class; same_as is then of the text of the smallest same_as. Rows without doc_id
    are not compared and give one row of nulls (see common.keyed); without documents there are no rows. Other columns are
    ignored. Returns doc_id, class_id (smallest doc_id of the class), same_as (smallest doc_id with the same words).
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(docs.mapInArrow(_sketch(shingle, bands, rows), "doc_id long, print binary, bands array<long>"), "near-sketch")
    worded = seen.where("print is not null and doc_id is not null")
    # a text's node: its smallest doc_id, or a number above all of them where another text has taken that
    firsts = worded.groupBy("print").agg(F.min("doc_id").alias("same_as"), F.any_value("bands").alias("bands"))
    taken = F.row_number().over(Window.partitionBy("same_as").orderBy("print"))
    firsts = cut(firsts.withColumn("nth", taken), "near-firsts")
    top = firsts.agg(F.max("same_as"), F.max("nth")).first()
    if top[1] is not None and top[1] > 1:
        free = F.monotonically_increasing_id() + (max(top[0], -1) + 1)
        firsts = cut(firsts.withColumn("id", F.when(F.col("nth") == 1, F.col("same_as")).otherwise(free)), "near-nodes")
    else:
        firsts = firsts.withColumn("id", F.col("same_as"))
    same = cut(worded.select("doc_id", "print").join(firsts.select("print", "same_as", "id"), "print").select("doc_id", "same_as", "id"), "near-same")
    heads = firsts.select("id", "bands")
    members = heads.select("id", F.explode("bands").alias("key"))
    leads = cut(members.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead"), "near-leads")
    shared = cut(members.join(leads, "key").select("key", "lead", "id"), "near-buckets")
    asked = cut(shared.select("id").distinct(), "near-asked")
    # the same plan at every size: texts are dealt by id, never the ids to all tasks
    if top[1] is not None and top[1] > 1:  # an id doesn't tell a text: by the words' print
        who = asked.join(firsts.select("id", "print"), "id")
        rows = docs.mapInArrow(_printed(), "print binary, text string").join(who.hint("merge"), "print").dropDuplicates(["id"]).select("id", "text")
    else:
        rows = docs.withColumnRenamed("doc_id", "id").join(asked.hint("merge"), "id", "left_semi").select("id", "text")
    texts = cut(rows.mapInArrow(_pack(shingle), "id long, z binary, n long, bits array<long>").dropDuplicates(["id"]), "near-texts")
    marks = texts.select("id", "n", "bits")

    def able_to_link(pairs: DataFrame) -> DataFrame:
        """Of the pairs a < b those that could link."""
        left, right = (marks.select(F.col("id").alias(x), F.struct("n", "bits").alias(y)) for x, y in (("a", "l"), ("b", "r")))
        return pairs.distinct().join(left, "a").join(right, "b").where(could_link("l", "r", similarity)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Distinct pairs with their similarity."""
        pairs = cut(pairs, "near-pairs")
        with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
        both = with_b.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
        return cut(both.select("a", "b", "za", "zb").mapInArrow(_overlap(shingle), "a long, b long, sim double"), "near-verified")

    def mixed(known: DataFrame) -> DataFrame:
        """Rows of buckets that hold several classes."""
        keys = cut(known.groupBy("key").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 < c1").select("key"), "near-mixed")
        return known.join(keys, "key")

    def labelled(known: DataFrame, classes: DataFrame) -> DataFrame:
        """``known`` with the present class of each id."""
        return known.drop("class").join(classes.select("id", F.col("class_id").alias("class")), "id", "left").withColumn("class", F.coalesce("class", "id"))

    def merged(classes: DataFrame, found: DataFrame) -> DataFrame:
        """The classes once those that the links ``found`` connect are one: only the classes' labels are connected."""
        of = lambda side: classes.select(F.col("id").alias(side), F.col("class_id").alias(f"_{side}"))
        ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
        ends = cut(ends.select("a", "b", F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y")), "near-ends")
        low = connected(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), "near-merged").select(F.col("id").alias("class_id"), F.col("class_id").alias("low"))
        everyone = classes.union(ends.select("a", "x")).union(ends.select("b", "y")).distinct()
        return cut(everyone.join(low, "class_id", "left").select("id", F.coalesce("low", "class_id").alias("class_id")), "near-classes")

    done = verified(able_to_link(shared.where("lead < id").select(F.col("lead").alias("a"), F.col("id").alias("b"))))
    links = done.where(F.col("sim") >= similarity).select("a", "b")
    classes = connected(links, "near-classes")
    open_ = cut(mixed(labelled(shared.select("key", "id"), classes)).join(marks.select("id", "n"), "id"), "near-open")
    if not open_.isEmpty():
        bag = texts.select("id", "z").join(open_.select("id").distinct(), "id", "left_semi").mapInArrow(_shingles(shingle), "id long, h long, c long")
        private = bag.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.any_value("id").alias("id"), F.any_value("c").alias("c")).where("k = 1").groupBy("id").agg(F.sum("c").alias("u"))
        least = cut(open_.groupBy("key").agg(F.min("n").alias("least")), "near-least")
        able = open_.join(cut(private, "near-private"), "id", "left").join(least, "key").withColumn("u", F.coalesce("u", F.lit(0)))
        need = similarity / (1 + similarity) * (F.col("n") + F.greatest(F.col("least"), similarity * F.col("n")))  # of shared weight
        able = cut(mixed(able.where(F.col("n") - F.col("u") >= need - 1e-6)).select("key", "id", "n", "u", "class"), "near-able")
        pivot = cut(able.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "id", "class")).alias("p")).select("key", F.col("p.id").alias("y"), F.col("p.class").alias("other")), "near-pivots")
        round_ = able.join(pivot, "key").where("class != other").select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b"))
        classes = merged(classes, verified(able_to_link(round_)).where(F.col("sim") >= similarity).select("a", "b"))
        left = cut(mixed(labelled(able, classes)).select("key", "id", "class", "n").join(marks.select("id", "bits"), "id"), "near-left")
        if not left.isEmpty():
            more = verified(_crossing(left, similarity)).where(F.col("sim") >= similarity).select("a", "b")
            if not more.isEmpty():
                classes = merged(classes, more)
    if top[1] is not None and top[1] > 1:  # the texts of one id are in one class
        nodes = same.select("doc_id", "id").distinct()
        ends = nodes.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("doc_id", "a")
        joined = nodes.join(ends, "doc_id").where("id > a").select("a", F.col("id").alias("b"))
        classes = merged(classes, joined)
    own = same.groupBy("doc_id").agg(F.min_by(F.struct("same_as", "id"), F.struct("same_as", "id")).alias("s")).select("doc_id", "s.same_as", "s.id")
    out = seen.select("doc_id").dropDuplicates().join(own, "doc_id", "left").withColumn("same_as", F.coalesce("same_as", "doc_id"))
    return out.join(classes, "id", "left").select("doc_id", F.coalesce("class_id", "same_as").alias("class_id"), "same_as")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
