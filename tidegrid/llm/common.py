"""What the operators share: written tables that cut lineage, ratios, connected classes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local session gets one of its own where none is set; on a cluster that is a RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return re.sub("^file:/(?!/)", "file:///", found).rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Bytes of one Arrow batch between Spark and a Python worker: whole texts are long, and a batch is held on both sides.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Let the session send small batches to Python workers, unless it has a setting of its own: an executor's memory is shared by its
    JVM and its workers. The setting stays, as the rows are only computed after the operator has returned."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name already."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a column ``key``, a long that no two rows share: the doc_id where only this row has it, else a number above all ids.

    Rows without id, and those that share theirs, are written once, so that their numbers stay."""
    named = docs.where("doc_id is not null")
    shared = cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "keyed-shared")
    many = not shared.isEmpty()
    lone = named.join(shared, "doc_id", "left_anti").select(*docs.columns) if many else named
    lone = lone.withColumn(key, F.col("doc_id").cast("long"))
    odd = docs.where("doc_id is null")
    if many:
        odd = odd.union(named.join(shared, "doc_id", "left_semi").select(*docs.columns))
    elif odd.isEmpty():
        return lone
    top = named.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).cast("long")).first()[0]
    return lone.union(cut(odd.withColumn(key, F.monotonically_increasing_id() + (max(top, -1) + 1)), "keyed-odd"))


def connected(nodes_with_links: DataFrame, name: str = "classes") -> DataFrame:
    """Connected components of the links ``a``, ``b`` (longs): rows ``id``, ``class_id`` (its smallest id).

    Each round takes the smallest label among neighbours and then that label's own label, both as
    joins and partial aggregates; the rounds end when no label changes. Ids without a link are absent.
    """
    links = nodes_with_links.select("a", "b").where("a != b")
    both = cut(links.union(links.select("b", "a")).distinct(), name + "-links")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), name)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        low = labels.join(near, "id").select("id", F.least("class_id", "near").alias("low"), F.col("class_id").alias("was"))
        up = labels.select(F.col("id").alias("low"), F.col("class_id").alias("up"))
        step = cut(low.join(up, "low", "left").select("id", F.least("low", F.coalesce("up", "low")).alias("class_id"), "was"), name)
        labels = step.select("id", "class_id")
        if step.where("class_id != was").isEmpty():
            return labels
