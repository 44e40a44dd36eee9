"""Helpers that the corpus operators share: scratch tables, table access and label folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as white space in word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark wherever `sf_dir` lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch that holds whole texts, at most (a text longer than that is a batch of its own).
TEXT_ROWS, TEXT_BYTES = 2_000, 4 << 20


def text_batches(docs: DataFrame) -> DataFrame:
    """`docs`, in a session whose Arrow batches have at most `TEXT_ROWS` rows and about `TEXT_BYTES` bytes.

    Spark's own limits (10,000 rows, 64 MB) make batches that are held several times over in the executor and its Python
    workers. The limits are settings of the session, so they hold for its later queries too; a session that already asks for smaller batches keeps its own.
    """
    conf = docs.sparkSession.conf
    for name, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864", TEXT_BYTES)):
        now = conf.get(name, usual)
        now = int(now) if now.lstrip("-").isdigit() else int(now.rstrip("b")) if now.rstrip("b").isdigit() else 0
        if now <= 0 or now > most:
            conf.set(name, str(most))
    return docs


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. A local session without one, as in tests, gets a folder of its own; on a cluster that is an error,
    since other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="loomgrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    The lineage ends at the written files, so losing an executor later costs a reread and no recomputation,
    and columns that a reader does not need are not read.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/loomgrid-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once nothing reads results that come from them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id falls into no fold (null)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % F.lit(folds)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else (Spark's lower also folds other scripts)."""
    return F.translate(col, UPPER, LOWER)


#: A class of equal rows is hot if it holds more than one in so many of all rows; so there are fewer hot classes than this.
HOT_SHARE = 1_000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, class_key: str, size: str, total: int) -> DataFrame:
    """Each of `rows` with the row of `classes` that has its key; `size` says how many rows a class has, `total` how many there are in all.

    Hot classes, fewer than `HOT_SHARE` whatever the input, are broadcast, so their rows stay where they are and no task receives a whole hot
    class; the others are joined by a shuffle. Keys are not null.
    """
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = classes.filter(is_hot), classes.filter(~is_hot)
    near = rows.join(F.broadcast(hot), F.col(key) == F.col(class_key))
    rest = rows.join(F.broadcast(hot.select(F.col(class_key).alias("hot_key"))), F.col(key) == F.col("hot_key"), "left_anti")
    return near.unionByName(rest.join(cold, F.col(key) == F.col(class_key)))


#: Rows of a range partition of `rank_rows` (more only beyond `MOST_PARTS` of them).
PART_ROWS, MOST_PARTS = 1 << 15, 20_000


def rank_rows(rows: DataFrame, key: str, order: list[Column], part_rows: int = PART_ROWS) -> DataFrame:
    """`rows` with r_part, r_rank from 0 within their key, and r_total, the rows of the key. `order` must tell all rows of a key apart; keys are not null.

    Rows are range-sorted by key and order, so a key that holds very many is spread over many tasks; a row's rank is its place in its part after the counts of the parts
    before, of which there is one row for each part and key.
    """
    parts = min(MOST_PARTS, max(1, -(-rows.count() // part_rows)))
    by = [F.col(key), *order]
    placed = materialize(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("r_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("r_part", F.shiftright("r_at", 33))
    own = placed.groupBy(F.col("r_part").alias("s_part"), F.col(key).alias("s_key")).agg(F.min("r_at").alias("s_first"), F.count("*").alias("s_count"))
    whole = Window.partitionBy("s_key")
    before = F.coalesce(F.sum("s_count").over(whole.orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(own.select("s_part", "s_key", (before - F.col("s_first")).alias("s_shift"), F.sum("s_count").over(whole).alias("r_total")))
    met = placed.join(sizes, (F.col("r_part") == F.col("s_part")) & (F.col(key) == F.col("s_key")))
    return met.withColumn("r_rank", F.col("r_at") + F.col("s_shift")).drop("s_part", "s_key", "s_shift", "r_at")
