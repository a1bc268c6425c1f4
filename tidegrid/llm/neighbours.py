"""Operator 1: nearest neighbours by vantage-point trees, one per shard, pruned by the triangle inequality.

The largest inner products are the smallest Euclidean distances once each vector x of norm at most M gets the
coordinate sqrt(M^2 - |x|^2) and each query the coordinate 0. In that space a small tree, made on the driver from a
bounded sample, deals the vectors to cells; each cell is cut into shards of bounded size and of like norms, and each
shard is one vantage-point tree. A query first searches its own cell, which gives it a radius, and then only those cells whose least
possible distance is within that radius, and in their trees only those branches whose least possible distance, times ``factor``, is.
A tree takes M from its own vectors and queries of norm M, so that distances in it are of the order of M and ``factor`` means
the same whatever the norms of vectors and queries. ``factor`` 1 is exact search; a larger one prunes more and may miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, table

LEAF = 64
#: Shards hold vectors whose norms differ by this factor at most, but for the shortest ones.
BAND, BANDS = 2.0**0.25, 128


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that turns inner products into distances."""
    rest = np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, rest])


def _far(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - at) ** 2).sum(axis=1), 0.0))


class Tree:
    """A balanced vantage-point tree: ``order`` permutes the points so that each node is a range of them.

    A node of more than ``leaf`` points has a vantage point and its nearer half (with the vantage point itself)
    before its farther half; ``inner`` is the largest distance in the nearer, ``outer`` the least in the farther one."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaf, n = leaf, len(points)
        self.order = np.arange(n)
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, float, float]] = {}
        todo = [(0, n)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                continue
            mine = self.order[lo:hi]
            spot = points[mine[_far(points[mine], points[mine].mean(axis=0)).argmax()]]  # an outlying point cuts best
            d = _far(points[mine], spot)
            by = np.argsort(d, kind="stable")
            half = (hi - lo + 1) // 2
            self.order[lo:hi] = mine[by]
            self.nodes[lo, hi] = (spot, float(d[by[half - 1]]), float(d[by[half]]))
            todo += [(lo, lo + half), (lo + half, hi)]

    def halves(self, lo: int, hi: int) -> tuple[tuple[int, int], tuple[int, int]]:
        half = (hi - lo + 1) // 2
        return (lo, lo + half), (lo + half, hi)

    def leaves(self, n: int) -> list[tuple[int, int]]:
        out, todo = [], [(0, n)]
        while todo:
            at = todo.pop()
            if at in self.nodes:
                todo += self.halves(*at)[::-1]
            else:
                out.append(at)
        return out


class Router:
    """The driver's tree over a sample: which cell a vector falls in, and how near each cell can be."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        n = max(1, len(sample))
        self.tree = Tree(sample, -(-n // max(1, cells)))
        self.top = (0, len(sample))
        self.cells = {at: i for i, at in enumerate(self.tree.leaves(len(sample)))}

    def home(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int32), [(self.top, np.arange(len(points)))]
        while todo:
            at, who = todo.pop()
            if at in self.cells:
                out[who] = self.cells[at]
                continue
            spot, inner, outer = self.tree.nodes[at]
            near = _far(points[who], spot) < (inner + outer) / 2
            a, b = self.tree.halves(*at)
            todo += [(a, who[near]), (b, who[~near])]
        return out

    def least(self, points: np.ndarray) -> np.ndarray:
        """A lower bound of each point's distance to each cell: a cell lies on one side of the middle radius of each node above it."""
        out = np.zeros((len(points), len(self.cells)))
        todo = [(self.top, np.zeros(len(points)))]
        while todo:
            at, bound = todo.pop()
            if at in self.cells:
                out[:, self.cells[at]] = bound
                continue
            spot, inner, outer = self.tree.nodes[at]
            d, middle = _far(points, spot), (inner + outer) / 2
            a, b = self.tree.halves(*at)
            todo += [(a, np.maximum(bound, d - middle)), (b, np.maximum(bound, middle - d))]
        return out


class Shard:
    """One shard's points in tree order, ready to be searched by blocks of queries."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        self.most = float(np.sqrt((x * x).sum(axis=1).max())) if len(x) else 0.0
        self.tree = Tree(lift(x, self.most), leaf)
        self.keys, self.x = keys[self.tree.order], x[self.tree.order]
        self.compared = 0  # pairs of queries and points so far

    def search(self, q: np.ndarray, least: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Each query's k largest inner products (-inf: none) and their places; only products of ``least`` or more are sought."""
        n, m = len(self.x), len(q)
        scale = self.most / np.sqrt((q * q).sum(axis=1))
        lifted = np.column_stack([q * scale[:, None], np.zeros(m)])
        base = 2 * self.most**2
        best, place = np.full((m, k), -np.inf), np.full((m, k), -1)
        radius = np.sqrt(np.maximum(base - 2 * scale * least, 0)) + 1e-9 * (1 + self.most)
        home = np.full(m, -1)
        slack = 1e-9 * (1 + self.most)

        def look(at: tuple[int, int], who: np.ndarray) -> None:
            lo, hi = at
            self.compared += len(who) * (hi - lo)
            value = np.concatenate([best[who], q[who] @ self.x[lo:hi].T], axis=1)
            where = np.concatenate([place[who], np.broadcast_to(np.arange(lo, hi), (len(who), hi - lo))], axis=1)
            top = np.argpartition(-value, k - 1, axis=1)[:, :k]
            kth = np.take_along_axis(value, top, 1).min(axis=1)
            tied = np.flatnonzero(((value >= kth[:, None]) & (where >= 0)).sum(axis=1) > k)
            for r in tied:  # of equal values the smaller keys
                top[r] = np.lexsort((self.keys[where[r]], -value[r]))[:k]
            best[who], place[who] = np.take_along_axis(value, top, 1), np.take_along_axis(where, top, 1)
            kth = best[who].min(axis=1)
            radius[who] = np.minimum(radius[who], np.sqrt(np.maximum(base - 2 * scale[who] * kth, 0)) + slack)

        todo = [((0, n), np.arange(m))]
        while todo:  # each query's own leaf first, for a small radius
            at, who = todo.pop()
            if not len(who):
                continue
            if at not in self.tree.nodes:
                home[who] = at[0]
                look(at, who)
                continue
            spot, inner, outer = self.tree.nodes[at]
            near = _far(lifted[who], spot) < (inner + outer) / 2
            a, b = self.tree.halves(*at)
            todo += [(a, who[near]), (b, who[~near])]
        todo = [((0, n), np.arange(m), np.zeros(m))]
        while todo:
            at, who, bound = todo.pop()
            keep = bound * factor <= radius[who] + slack
            who, bound = who[keep], bound[keep]
            if not len(who):
                continue
            if at not in self.tree.nodes:
                who = who[home[who] != at[0]]
                if len(who):
                    look(at, who)
                continue
            spot, inner, outer = self.tree.nodes[at]
            d = _far(lifted[who], spot)
            a, b = self.tree.halves(*at)
            todo += [(a, who, np.maximum(bound, d - inner)), (b, who, np.maximum(bound, outer - d))]
        return best, place


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _pack(key: tuple, points: pa.Table) -> pa.Table:
    """The points of one shard to one row: its keys and vectors in tree order."""
    points = points.combine_chunks()
    by = np.argsort(points["key"].to_numpy(), kind="stable")
    s = Shard(points["key"].to_numpy()[by], _matrix(points["vec"].combine_chunks())[by])
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "sub": pa.array([key[1].as_py()], pa.int32()), "keys": pa.array([s.keys.astype("<i8").tobytes()], pa.binary()), "x": pa.array([s.x.astype("<f8").tobytes()], pa.binary())})


def _search(k: int, factor: float):
    """Rows of a shard (asked is null) and then of its blocks of queries, shard after shard, to each query's best there: exact
    inner products, in double precision. One shard and one block are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                if not batch.column("asked")[i].is_valid:
                    keys = np.frombuffer(batch.column("keys")[i].as_py(), "<i8")
                    shard = Shard(keys, np.frombuffer(batch.column("x")[i].as_py(), "<f8").reshape(len(keys), -1))
                    continue
                asked = batch.column("asked")[i].values
                q, names, least = _matrix(asked.field("vec")), asked.field("qkey").to_numpy(), asked.field("least").to_numpy()
                best, place = shard.search(q, least, k, factor)
                r, c = np.nonzero(best > -np.inf)
                at = place[r, c]
                score = np.concatenate([(q[r[j : j + 65536]] * shard.x[at[j : j + 65536]]).sum(axis=1) for j in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(names[r], pa.int64()), pa.array(shard.keys[at], pa.int64()), pa.array(score)], ["qkey", "key", "score"])

    return run


#: How much the query relaxes the bounds: chosen by recall (0.9 at least) and by the share of pairs compared, see the README.
FACTOR = 6.0


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard_rows: int = 8192, sample_rows: int = 20_000, max_cells: int = 512, block: int = 2048, crowd: int = 16) -> DataFrame:
    """The ``k`` vectors of largest inner product for each vector whose vec_id is divisible by ``every``.

    ``vectors``: vec_id, embedding; other columns are ignored. Returns query_id, rank (from 1), vec_id, score, where ties go
    to the smaller vec_id and a query never finds its own row. Without an id, or with an embedding that is null, zero
    or holds null or non-finite components, a row takes no part; nor do vectors of another than the most frequent length (the
    smaller, if tied). Rows that repeat a vec_id count once, with the least of their vectors. An empty table gives no rows.

    ``factor`` 1 finds exactly these. A larger one compares fewer pairs and may miss some.

    Equal vectors are searched once, for at most k + 1 of their ids, which is all that any query can return of them. The
    router's sample (``sample_rows``) and number of cells (``max_cells``) are bounded; every vector is indexed.
    """
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return none
    rows = rows.where(F.size("vec") == size[0]["n"]).groupBy("id").agg(F.min("vec").alias("vec"))
    prints = [F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(7), F.reverse("vec")).alias("g")]
    rows = cut(rows.select("id", "vec", *prints), "ann-rows")
    salted = Window.partitionBy("h", "g", F.pmod("id", F.lit(32))).orderBy("id")
    whole = Window.partitionBy("h", "g").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    points = few.groupBy("h", "g").agg(F.min("id").alias("key"), F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("vec").alias("vec"))
    points = cut(points, "ann-points")
    asking = rows.where(F.col("id") % every == 0)
    queries = cut(asking.groupBy("h", "g").agg(F.min("id").alias("qkey"), F.any_value("vec").alias("vec")), "ann-queries")

    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, most = points.agg(F.count(F.lit(1)), F.sqrt(F.max(norm))).first()
    asked = queries.count()
    if not asked:
        return none
    cells = int(min(max_cells, -(-n // shard_rows)))
    sample = points.select("vec").orderBy(F.xxhash64("key")).limit(sample_rows) if cells > 1 else points.select("vec").limit(1)
    router = spark.sparkContext.broadcast(Router(lift(np.array([r[0] for r in sample.collect()], np.float64), most), cells))
    blocks = int(max(1, -(-asked // block)))

    @F.arrow_udf("int")
    def home(vec: pa.Array) -> pa.Array:
        return pa.array(router.value.home(lift(_matrix(vec), most)), pa.int32())

    @F.arrow_udf("int")
    def own(vec: pa.Array) -> pa.Array:
        q = _matrix(vec)
        return pa.array(router.value.home(np.column_stack([q, np.zeros(len(q))])), pa.int32())

    @F.arrow_udf("array<int>")
    def reach(vec: pa.Array, radius: pa.Array, skip: pa.Array) -> pa.Array:
        q = _matrix(vec)
        near = router.value.least(np.column_stack([q, np.zeros(len(q))])) <= radius.to_numpy()[:, None]
        near[np.arange(len(q)), skip.to_numpy()] = False
        return pa.array([np.flatnonzero(x).astype(np.int32) for x in near], pa.list_(pa.int32()))

    band = F.least(F.lit(BANDS - 1), F.floor(F.log(F.lit(most) / F.sqrt(norm)) / math.log(BAND) + 1e-9)).cast("int")
    dealt = cut(points.select("key", "vec", home("vec").alias("cell"), F.greatest(band, F.lit(0)).alias("band")), "ann-dealt")
    # cells and bands that are crowded are cut by their own counts: at most max_cells * BANDS rows
    subs = dealt.groupBy("cell", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("subs"))
    first_sub = F.coalesce(F.sum("subs").over(Window.partitionBy("cell").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    subs = cut(subs.withColumn("first", first_sub), "ann-subs")
    sub = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("subs"))).cast("int")
    dealt = dealt.join(F.broadcast(subs), ["cell", "band"]).select("cell", sub.alias("sub"), "key", "vec")
    shards = cut(dealt.groupBy("cell", "sub").applyInArrow(_pack, "cell int, sub int, keys binary, x binary"), "ann-shards")

    def searched(who: DataFrame) -> DataFrame:
        """who: qkey, vec, least, cell -> qkey, key, score.

        Each shard is sent once, or once for each ``crowd`` blocks that ask it, and its blocks after it."""
        part = F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int").alias("part")
        packed = cut(who.groupBy("cell", part).agg(F.collect_list(F.struct("qkey", "vec", "least")).alias("asked")), "ann-asked")
        copies = packed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(crowd)).cast("int").alias("copies"))
        copies = cut(copies, "ann-copies")  # at most max_cells rows
        sent = shards.join(F.broadcast(copies), "cell").select("cell", "sub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(-1).alias("part"), "keys", "x", F.lit(None).cast(packed.schema["asked"].dataType).alias("asked"))
        of = packed.join(F.broadcast(copies), "cell").join(shards.select("cell", "sub"), "cell")
        none = F.lit(None).cast("binary")
        asks = of.select("cell", "sub", F.pmod("part", "copies").alias("copy"), "part", none.alias("keys"), none.alias("x"), "asked")
        rows = sent.union(asks).repartition("cell", "sub", "copy").sortWithinPartitions("cell", "sub", "copy", "part")
        return rows.select("keys", "x", "asked").mapInArrow(_search(k + 1, factor), "qkey long, key long, score double")

    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "key")
    first = cut(queries.select("qkey", "vec", own("vec").alias("cell")), "ann-homes")
    found = cut(searched(first.withColumn("least", F.lit(float("-inf")))), "ann-first")
    if cells > 1:
        kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k + 1).select("qkey", F.col("score").alias("kth"))
        radius = F.when(F.col("kth").isNull(), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(norm + most * most - 2 * F.col("kth"), F.lit(0.0))) + 1e-9 * (1 + most))
        todo = first.join(kth, "qkey", "left").select("qkey", "vec", "cell", radius.alias("radius"), F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
        todo = todo.withColumn("cell", F.explode(reach("vec", "radius", "cell"))).drop("radius")
        found = found.union(cut(searched(todo), "ann-second"))
    # of the classes of equal vectors that a query found, the best k + 1; then of their ids
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    ids = top.join(points.select("key", F.explode("ids").alias("vec_id")), "key")
    by_id = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    lists = ids.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    salts = 16  # many queries may share one vector
    lists = lists.join(queries.select("qkey", "h", "g"), "qkey").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asking = asking.select(F.col("id").alias("query_id"), "h", "g", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    out = asking.join(cut(lists, "ann-lists"), ["h", "g", "salt"])
    kept = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(kept).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))


def op1_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), factor=FACTOR)
