"""Settings of a project: defaults, then the nearest loom.json up the folders, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from ledgerloom.functions.naming import Naming

FILE = "loom.json"
#: Environment variables and the settings they override.
ENVIRONMENT = {"LOOM_LEDGER": "ledger", "LOOM_MANIFEST": "manifest", "LOOM_SNAPSHOT": "snapshot"}


@dataclass
class Config:
    root: Path
    migrations: list[str] = field(default_factory=lambda: ["migrations"])
    manifest: str = "manifest.json"
    ledger: str = "ledger"
    snapshot: str = "schema.sql"
    naming: Naming = field(default_factory=Naming)
    severity: dict[str, str] = field(default_factory=dict)
    rules: str = "lint_rules"
    dependencies: dict[str, list[str]] = field(default_factory=dict)

    def path(self, name: str) -> Path:
        return self.root / name


def find(start: str | Path) -> Path | None:
    here = Path(start).resolve()
    return next((p / FILE for p in (here, *here.parents) if (p / FILE).is_file()), None)


def load(start: str | Path) -> Config:
    found = find(start)
    given = json.loads(found.read_text()) if found else {}
    known = {k: v for k, v in given.items() if k in Config.__dataclass_fields__ and k not in ("root", "naming")}
    if isinstance(known.get("migrations"), str):
        known["migrations"] = [known["migrations"]]
    known |= {setting: os.environ[name] for name, setting in ENVIRONMENT.items() if name in os.environ}
    return Config(root=found.parent if found else Path(start).resolve(), naming=Naming(**given.get("naming", {})), **known)
