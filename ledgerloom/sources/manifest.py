"""The manifest: a JSON document of recorded files and their checksums, of a size that the driver writes by itself.

It lies beside the project's other files, or, given as a URI, in any store that Spark writes to.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.storage import exists, read_text, write_text

ROWS = "file string, checksum string"


@dataclass
class Manifest:
    entries: dict[str, str] = field(default_factory=dict)
    model: str | None = None
    since: str | None = None

    @property
    def is_graph(self) -> bool:
        return self.model == "dag"

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.entries.items()), ROWS)


def load(path: str | Path) -> Manifest:
    """The manifest in a file; an empty one if there is none. What doesn't have the right shape is refused."""
    if isinstance(path, str) and ":/" in path:
        spark = SparkSession.getActiveSession()
        text = read_text(spark, path) if exists(spark, path) else None
    else:
        text = Path(path).read_text() if Path(path).exists() else None
    if text is None:
        return Manifest()
    data = json.loads(text)
    rows = data.get("migrations") if isinstance(data, dict) else None
    fits = isinstance(rows, list) and all(isinstance(r, dict) and isinstance(r.get("file"), str) and isinstance(r.get("checksum"), str) for r in rows)
    if not fits or data.get("model") not in (None, "dag") or not isinstance(data.get("modelSince", ""), str):
        raise ValueError(f"{path} is not a manifest")
    return Manifest({r["file"]: r["checksum"] for r in rows}, data.get("model"), data.get("modelSince"))


def save(manifest: Manifest, path: str | Path) -> None:
    data = {"model": manifest.model, "modelSince": manifest.since, "migrations": [{"file": f, "checksum": c} for f, c in manifest.entries.items()]}
    text = json.dumps({k: v for k, v in data.items() if v is not None}, indent=2) + "\n"
    if isinstance(path, str) and ":/" in path:
        write_text(SparkSession.getActiveSession(), path, text)
    else:
        Path(path).write_text(text)
