"""Session helpers: reading tables, shared-folder materialisation, size-checked broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes as estimated by the optimizer, that is ever broadcast by hint.
BROADCAST_LIMIT = 8 << 20


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the dataset folder ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share.

    ``spark.checkpoint.dir`` of the session is used where it is set. Only a
    session within one process (``local`` or ``local[...]``) without that setting
    gets a folder of its own; any other one without it is an error, as a
    machine-local folder would be lost with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_gridweave_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="gridweave-")
        spark._gridweave_dir = own
    return own


class Materialized:
    """A DataFrame written to the shared folder and read back; ``drop`` removes the files."""

    def __init__(self, df: DataFrame, tag: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/gridweave/{tag}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        _written(self.spark).append(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def _written(spark: SparkSession) -> list[str]:
    """Folders of intermediate tables that this session wrote."""
    if not hasattr(spark, "_gridweave_written"):
        spark._gridweave_written = []
    return spark._gridweave_written


def cleanup(spark: SparkSession) -> None:
    """Remove this session's intermediate tables; results that were not read yet are lost with them."""
    for path in _written(spark):
        remove(spark, path)
    _written(spark).clear()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df`` by a table written to the shared folder."""
    return Materialized(df, tag).df


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    """A small driver-side text file (a plan or a commit marker)."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a small folder."""
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)]


def glob_names(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches a path pattern."""
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def put_text(spark: SparkSession, path: str, text: str, rename: bool = True) -> None:
    """Write a small text file under another name and put it in place by one atomic rename, over an older one.

    Without ``rename`` the file stays under its other name, as after a
    break-off in between.
    """
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if rename:
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(tmp), fs.makeQualified(p), how)


write_text = put_text


def work_folder(spark: SparkSession, tag: str) -> str:
    """The name of a new folder among the intermediate tables, removed by ``cleanup``."""
    path = f"{shared_dir(spark)}/gridweave/{tag}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    return path


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; without statistics it is very large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast ``df`` if its estimated size is under ``limit``, else leave the join to the optimizer."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gridweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridweave-package-")) / "gridweave.zip"
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._gridweave_shipped = True
