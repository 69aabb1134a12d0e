"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application.

    Functions given to ``mapInArrow`` and the like are pickled by reference, so the workers must be able to import them.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="seqloom-ship-")  # the driver's own: its file server hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "seqloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for where, _, names in os.walk(PACKAGE_DIR):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.join("seqloom", os.path.relpath(full, PACKAGE_DIR)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("seqloom").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a folder of this session is made instead.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="seqloom-shared-")
    return _OWN_DIRS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/seqloom-{label}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose materialised folders are deleted when it ends; frames made inside must not be used after it."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        delete(spark, made)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders through Hadoop's file systems, as they were written."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _own_path(spark: SparkSession, label: str) -> str:
    path = fresh_path(spark, label)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: losing executors later costs nothing that was done before.
    """
    path = _own_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, materialised; what it materialised on the way is deleted."""
    path = _own_path(spark, label)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
