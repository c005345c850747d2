"""Session helpers and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the command line; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sparrix")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python, unless they find it by themselves.

    They do if it is on PYTHONPATH, or if they run in the folder that holds it.
    """
    package = Path(__file__).resolve().parent
    root, context = str(package.parent), spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or is_local(spark) and os.getcwd() == root or getattr(context, "_sparrix_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="sparrix-")) / "sparrix.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in package.rglob("*.py"):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._sparrix_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in local mode, where driver and executors are one process, may
    go without the setting; a temporary folder is then set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparrix-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted at the end."""
    path = f"{shared_dir(spark)}/sparrix-{os.getpid()}/{tag}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage without keeping anything on an executor.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparrix_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the table behind a result of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_sparrix_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that ``materialize`` wrote for this session; frames that read them are of no more use."""
    for owner, path in [x for x in _WRITTEN if x[0] is spark]:
        _delete(spark, path)
        _WRITTEN.remove((owner, path))


@atexit.register
def _release_at_exit() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # the JVM may be gone already
            pass
