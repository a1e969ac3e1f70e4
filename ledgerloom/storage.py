"""Where results are cut off from their lineage: the folder that all executors share; and the package on executors."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def shared_folder(spark: SparkSession) -> str:
    """The URI of the shared folder (spark.checkpoint.dir). Only a local master may go without the setting."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="ledgerloom-")).as_uri()
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else Path(found).as_uri()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run: its modules as an archive in the shared folder, which
    executors get from there. Once for each Spark context."""
    context = spark.sparkContext
    if any(name.startswith("ledgerloom-") for name in context._python_includes):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(Path(PACKAGE.name) / path.relative_to(PACKAGE))), path.read_bytes())
    name = f"{shared_folder(spark).rstrip('/')}/ledgerloom-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(name)


def scratch(spark: SparkSession, what: str) -> str:
    """A name, not in use yet, for a folder inside the shared one. It goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    store, found = _path(spark, path)
    store.mkdirs(found)  # what isn't there can't be marked
    store.deleteOnExit(found)
    store.delete(found, True)
    return path


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's; without a scheme, that of the cluster's default."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = _path(spark, path)
    return store.exists(found)


def read_text(spark: SparkSession, path: str) -> str:
    store, found = _path(spark, path)
    stream = store.open(found)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    store, found = _path(spark, path)
    out = store.create(found, replace)
    out.write(bytearray(text.encode()))
    out.close()


def delete(spark: SparkSession, uri: str) -> None:
    """Delete a file by its URI, as Spark names it, with percent codes."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(uri))
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, False)


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared one, by its URI as Spark names it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(uri))
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
