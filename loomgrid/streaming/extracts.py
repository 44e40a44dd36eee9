"""A stream of extract files that replaces years of a layer: of a batch, each year that it holds is rewritten whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomgrid.plans.sinks import write_years


def replace_years(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, column: str = "YEAR", files_per_batch: int = 1) -> StreamingQuery:
    """Start a query over Parquet files arriving in `source`. A batch run again after a failure writes the same years again, so nothing is doubled."""

    def put(batch: DataFrame, _: int) -> None:
        write_years(batch, target, column)

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
