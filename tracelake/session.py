"""Session settings, shared scratch tables and plan-size helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every plan of this package is written for.  They are runtime SQL
# settings, so they can also be applied to a session somebody else built.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows here fan out (20 history rows per log), so small shuffles still carry
    # work: let AQE keep as many partitions as there are cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches for Python are bounded by bytes too: texts can be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app: str = "tracelake", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once per application, so that their Python finds it from any folder."""
    marker, root = "tracelake.shipped", Path(__file__).resolve().parent
    if spark.conf.get(marker, None) == spark.sparkContext.applicationId or not root.is_dir():
        return spark
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "tracelake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set(marker, spark.sparkContext.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local-mode session without that setting gets a folder of its own; a
    cluster session without it is an error, because a machine-local folder
    would be lost together with its machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    made = os.path.join(tempfile.gettempdir(), f"spark-{uuid.uuid4().hex}")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tracelake-{spark.sparkContext.applicationId}"


_recorders: list[list[str]] = []


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The scratch paths that are made inside, for :func:`drop_paths`."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def scratch_path(spark: SparkSession) -> str:
    """A fresh path below this application's scratch folder."""
    path = f"{_scratch_root(spark)}/{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage (iterative fits) and freezes values that a recomputation
    could change (ids given by partition).  The copy survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table :func:`materialise` wrote in this application."""
    drop_paths(spark, [_scratch_root(spark)])
