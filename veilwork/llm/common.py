"""Helpers shared by the training-data operators: written intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that Python workers get by bytes, not by rows alone, so that long texts do not add up.
    This holds for the session's later plans, too; a smaller bound set by the user stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(name, None)
    if not (found and found.isdigit() and int(found) <= size):
        spark.conf.set(name, str(size))


def give_back() -> None:
    """Return a Python worker's freed memory to the system at a task's end; Spark keeps the worker for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, the warehouse on a cluster unless that is a folder of one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        found = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir")
        if local:
            spark.conf.set("spark.checkpoint.dir", found)
        elif found.startswith("file:") or found.startswith("/"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def row_key(id_col, text_col) -> F.Column:
    """Never null; equal for rows of equal id and text only, so that rows which repeat an id with another text are told apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.concat_ws(":", named, F.octet_length(text).cast("string"), F.xxhash64(text).cast("string"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like these, in order, that no column of docs has, in whatever case."""
    have = {c.lower() for c in docs.columns}
    longest = max(map(len, have), default=0)
    return [name if name.lower() not in have else name.ljust(longest + 1, "_") for name in names]


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, once: bool = False) -> DataFrame:
    """The rows of docs, all columns, whose row_key() is not in gone(key); with `once` only one of the rows of a key. One plan at every size, one shuffle."""
    key, drop, nth = unused(docs, "__key", "__gone", "__nth")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    gone = materialise(gone.select(F.col("key").alias(drop)).distinct())
    left = keyed.join(gone.hint("merge"), F.col(key) == F.col(drop), "left_anti")
    if once:
        left = left.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1)
    return left.select(*[left[c] for c in docs.columns])


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing
    before it, and joins of two such tables have plain exchanges that adaptive execution may split when skewed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what materialise() wrote, once no later plan reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph given as (a long, b long).

    Alternates two star contractions: each node's larger, then smaller neighbours are hung on its smallest
    neighbour, until nothing changes. Edges stay distributed; only a count and a checksum per round reach the
    driver. Returns (node, component_id) for nodes that have an edge to another node; self-loops and null ends
    are ignored; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges)

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = sign(edges)
    for _ in range(max_rounds):
        if not last[0]:
            break
        # Minima are written before they are joined back: a join of two tables may be split where a node has very many neighbours
        both = edges.union(edges.select("v", "u"))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        drop_written(low)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
        hung = large.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        small = materialise(hung.where("u <> v").distinct())
        for x in (low, large, edges):
            drop_written(x)
        edges, now = small, sign(small)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("node"), "component_id")
    return stars.union(edges.select("v", "v").distinct()).groupBy("node").agg(F.min("component_id").alias("component_id"))
