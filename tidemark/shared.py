"""What a job shares between driver and executors: a folder, written tables and this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    Only a session on one machine (`local[...]`) may leave it unset; it then gets a temporary
    folder. A cluster must name one, because executors do not see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "local" not in _LOCAL:
        _LOCAL["local"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL["local"], ignore_errors=True)
    return _LOCAL["local"]


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh, not yet existing folder below the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


#: Folders of tables that belong to the open scratch blocks, innermost last.
_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, *, stays: bool = False) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the later steps only, and work that several
    branches use is done once. Inside a `scratch` block the table goes when the block ends; one
    that `stays` goes with the next outer block, if there is one.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    blocks = _SCRATCH[:-1] if stays else _SCRATCH
    if blocks:
        blocks[-1].append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised in the block are deleted at its end.

    What is to be read later must be materialised with `stays`.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for folder in _SCRATCH.pop():
            drop_folder(spark, folder)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions of the package are pickled by name, so workers must be able to import it.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-", dir=None)
    archive = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
