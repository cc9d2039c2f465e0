"""Sessions and the shipping of this package's code to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from tieout.model import InvalidConfiguration

_SHIPPED: set[str] = set()
T = TypeVar("T")
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once for each application; a cluster that has it installed is not harmed."""
    # small batches bound what a worker and the JVM's Arrow buffers hold of long texts at a time
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tieout-code-")) / "tieout_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def local_session(name: str = "tieout", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and small runs on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "8g").getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where nothing is set and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise InvalidConfiguration("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tieout-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def together(*steps: Callable[[], T]) -> list[T]:
    """What independent steps give, made at the same time: each is jobs of its own, which wait for planning more than for tasks where
    tables are small and fill what the others leave free where they are not. The first error is raised after all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows neither recomputes it nor plans it again, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
