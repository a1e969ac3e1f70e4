"""The ledger: an append-only Parquet table of what was applied, and a lock so that one run writes at a time."""

from __future__ import annotations

import os
import socket
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.storage import delete, exists, read_text, write_text

SCHEMA = "id long, file_name string, checksum string, status string, applied_at timestamp, resolved_at timestamp"
STATUSES = ("applied", "failed", "skipped")


class Ledger:
    def __init__(self, spark: SparkSession, path: str | Path) -> None:
        self.spark, self.path = spark, str(path)

    def ensure(self) -> None:
        if not exists(self.spark, self.path):
            self.spark.createDataFrame([], SCHEMA).write.parquet(self.path)

    def rows(self) -> DataFrame:
        self.ensure()
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def ordered(self) -> DataFrame:
        return self.rows().orderBy("applied_at", "id")

    def of_file(self, file_name: str) -> DataFrame:
        return self.rows().where(F.col("file_name") == file_name).orderBy("applied_at", "id")

    def applied(self) -> DataFrame:
        return self.rows().where(F.col("status").isin("applied", "skipped")).select("file_name").distinct()

    def append(self, file_name: str, checksum: str, status: str) -> None:
        """One row more. resolved_at is set for skipped ones alone."""
        if status not in STATUSES:
            raise ValueError(f"no status {status!r}")
        now = datetime.now()
        number = (self.rows().agg(F.max("id")).first()[0] or 0) + 1
        self.spark.createDataFrame([(number, file_name, checksum, status, now, now if status == "skipped" else None)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def lock(self, wait_s: float = 60) -> Iterator[None]:
        """Held by one process at a time, through a file beside the table, made only if it isn't there, that names its
        owner. One whose owner, on this machine, has ended is taken over."""
        path, until = f"{self.path}.lock", time.monotonic() + wait_s
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        uri = store.makeQualified(jvm_path).toUri()
        local = uri.getPath() if uri.getScheme() == "file" else None
        owner = f"{socket.gethostname()} {os.getpid()} {datetime.now().isoformat()}"
        while True:
            try:
                if local:  # Hadoop's local file system looks and makes in two steps
                    Path(local).parent.mkdir(parents=True, exist_ok=True)
                    with open(local, "x") as f:
                        f.write(owner)
                else:
                    write_text(self.spark, path, owner, replace=False)
                break
            except Exception as e:  # that the file is there comes as an error of the JVM or of the system
                if not exists(self.spark, path):
                    if time.monotonic() > until:
                        raise
                    time.sleep(0.2)
                    continue
                held = read_text(self.spark, path)
                host, _, rest = held.partition(" ")
                if host == socket.gethostname() and rest.split(" ")[0].isdigit() and not _runs(int(rest.split(" ")[0])):
                    delete(self.spark, uri.toString())
                    continue
                if time.monotonic() > until:
                    raise TimeoutError(f"{path} is held by another run: {held}") from e
                time.sleep(0.2)
        try:
            yield
        finally:
            delete(self.spark, uri.toString())


def _runs(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True
