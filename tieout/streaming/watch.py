"""A watched folder as a stream: an extension beyond the batch engine. Each new file is parsed once and handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tieout.sources.batch import paired


def watch(spark: SparkSession, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``on_batch`` with the pairing of the files that each micro-batch found; the checkpoint makes each file count once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 1000).load(folder)
    names = files.selectExpr("regexp_extract(path, '([^/]*)$', 1) as filename")
    return names.writeStream.foreachBatch(lambda df, n: on_batch(paired(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
