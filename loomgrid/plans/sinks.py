"""Output files under a run folder. The prefix says what a table is for: analysis (models), presentation (reading), reference (descriptions)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

#: The kinds of files.
KINDS = ("analysis", "presentation", "reference")
#: Rows of a table that is written as one CSV file, at most.
CSV_ROWS = 100_000


def run_folder(root: str, now: datetime | None = None) -> str:
    """A folder named by the second; two runs within one second share it."""
    return f"{root.rstrip('/')}/run_{(now or datetime.now()):%Y%m%d_%H%M%S}"


def work_folder(spark: SparkSession) -> str:
    """A new folder for files of this application, under the shared one named in spark.checkpoint.dir.

    A local session without that setting gets a temporary folder that goes with it; elsewhere it is an error, as other machines would not see the files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="loomgrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomgrid-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def path(folder: str, kind: str, name: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"{kind!r} is none of {KINDS}")
    return f"{folder}/data/{kind}_{name}"


def write_table(df: DataFrame, folder: str, kind: str, name: str, csv: bool = True) -> list[str]:
    """Parquet and, read from what was written there, CSV: one file for a table of reading size, as many as there are tasks for a larger one."""
    out = [f"{path(folder, kind, name)}.parquet"]
    df.write.mode("overwrite").parquet(out[0])
    if csv:
        written = df.sparkSession.read.schema(df.schema).parquet(out[0])
        one = written.count() <= CSV_ROWS  # from the files' footers
        out.append(f"{path(folder, kind, name)}.csv")
        (written.coalesce(1) if one else written).write.mode("overwrite").option("header", True).csv(out[1])
    return out


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A stage's result, written under the run's folder and read from there: what uses it several times does not work it out again, and counts taken on the way are complete."""
    target = f"{folder}/intermediate/{name}_stage.parquet"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def write_years(layer: DataFrame, target: str, column: str = "YEAR") -> None:
    """A layer partitioned by year; writing some years again replaces these and leaves the others."""
    layer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(target)


def exported(df: DataFrame, kind: str, name: str, folder: str | None = None) -> DataFrame:
    """A table as it comes back from its own CSV, under `folder` or a new work folder."""
    written = write_table(df, folder or work_folder(df.sparkSession), kind, name)
    return reread(df.sparkSession, written[-1], df)


def write_intermediate(df: DataFrame, folder: str, name: str) -> list[str]:
    """A stage's result for inspection: Parquet with its types, and CSV without the columns that CSV cannot hold."""
    out = [f"{folder}/intermediate/{name}.parquet", f"{folder}/intermediate/{name}.csv"]
    df.write.mode("overwrite").parquet(out[0])
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "struct", "map")]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(out[1])
    return out


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """An exported CSV with the columns and types of the table it was written from; a row that does not fit is an error."""
    found = spark.read.schema(like.schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return found.select(*like.columns)
