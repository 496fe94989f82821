"""Session settings shared by the jobs, and the folder where lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows sent to Python at once: whole texts travel, so far fewer than Spark's default.
ARROW_ROWS = 2_000
#: Bytes sent to Python at once.
ARROW_BYTES = "16m"


#: Bytes of input for a task of work that is heavy for each byte, and up to which that rises once there are so many tasks.
SPREAD_BYTES, SPREAD_MOST, MANY_TASKS = 2_000_000, 64_000_000, 4_096


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "paragraf") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make all day arithmetic UTC."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it by the working folder or PYTHONPATH that they share."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_paragraf", False) or any(p and Path(p).resolve() == root.parent for p in places):
        return
    folder = tempfile.mkdtemp(prefix="paragraf-package-")  # the driver serves the file from here while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(out := Path(folder, "paragraf.zip"), "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._paragraf = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only where none is set, a local one for tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paragraf-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and go on from there: computed once, safe when executors are lost.

    A written table is smaller than a checkpoint and tells the optimizer its size. It is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    """Is the folder there? Someone else may have cleared what is shared."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place))


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """df by hash over as many tasks as its files have SPREAD_BYTES, at least as many as there are cores, beyond MANY_TASKS
    fewer larger ones: for work that is heavy for each byte, which large row groups would leave to a few tasks."""
    stats = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    known = int(stats) if int(stats) < 1 << 50 else 0  # without files the optimizer doesn't know
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(known // SPREAD_BYTES, max(MANY_TASKS, known // SPREAD_MOST)) + 1), *by)


def partitioned(df: DataFrame, by: list[str]) -> DataFrame:
    """df as a table in folders by these columns, in the shared folder: filters on them open only the folders they name."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append((spark, path))
    rest = [f for f in df.schema if f.name not in by]
    return spark.read.schema(StructType([*rest, *[df.schema[c] for c in by]])).parquet(path).select(*df.columns)


_written: list[tuple[SparkSession, str]] = []


def clear(only: SparkSession | None = None) -> None:
    """Remove the tables written so far, all or one session's: for a caller that has saved its results and goes on. What was
    read from them can't be computed again afterwards."""
    gone = [(spark, path) for spark, path in _written if only is None or spark is only]
    _written[:] = [x for x in _written if x not in gone]
    _remove(gone)


def _remove(places: list[tuple[SparkSession, str]]) -> None:
    for spark, path in places:
        with contextlib.suppress(Exception):  # the session may have ended before
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: What a session keeps until the driver ends, such as a search index without a folder of its own.
kept: list[tuple[SparkSession, str]] = []


@atexit.register
def _end() -> None:
    clear()
    _remove(kept)
