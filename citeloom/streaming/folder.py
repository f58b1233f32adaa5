"""Audit of files as they arrive in a folder. Every operator is per document, so a batch at a time needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import bibliography, citations, zones
from ..sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def audit(parts: DataFrame) -> DataFrame:
    zoned = zones.split_zones(files.lines(parts))
    return citations.compare(bibliography.entries(zoned), citations.first_citations(citations.brackets(zoned)))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the comparison of each new file to the Parquet table `out`."""

    def write(batch: DataFrame, epoch: int) -> None:
        audit(files.decode(batch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.format("binaryFile").schema(BINARY).load(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
