"""An extension: files that arrive are scanned and appended once. Not part of the batch engine's parity."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import scan
from ..session import ship


def watch(spark: SparkSession, root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Scans new files below root in micro-batches; each batch's findings are one append to the Parquet folder `table`."""
    stream = ship(spark).readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    write = lambda df, i: scan.detect(df.select("path", "length", "content")).drop("ord").write.mode("overwrite").parquet(f"{table}/batch={i}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
