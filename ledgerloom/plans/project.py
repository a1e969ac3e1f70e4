"""The commands over one project: scripts, manifest, ledger and a database of Spark's catalog."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import Config, load
from ledgerloom.functions.naming import next_serial
from ledgerloom.operators import graph, manifest, snapshot
from ledgerloom.operators import ledger as ledger_operators
from ledgerloom.plans import dependencies, lint
from ledgerloom.sources import catalog, scripts
from ledgerloom.sources import manifest as manifest_file
from ledgerloom.sources.ledger import Ledger
from ledgerloom.storage import delete


@dataclass
class Applied:
    applied: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    failed: str | None = None


class Project:
    def __init__(self, spark: SparkSession, root: str | Path, database: str = "default", config: Config | None = None) -> None:
        self.spark, self.database = spark, database
        self.config = config or load(root)
        self.ledger = Ledger(spark, self.config.path(self.config.ledger))

    def files(self) -> DataFrame:
        return scripts.scan(self.spark, [self.config.path(m) for m in self.config.migrations], self.config.naming)

    def manifest(self) -> manifest_file.Manifest:
        return manifest_file.load(self.config.path(self.config.manifest))

    def dependencies(self) -> dependencies.Dependencies:
        return dependencies.build(self.files(), self.config.dependencies)

    def lasts(self) -> DataFrame:
        """(file_name) that may be edited: leaves of the graph since its boundary, or the last file."""
        m = self.manifest()
        if not m.is_graph:
            return manifest.tail(self.files())
        found = self.dependencies().leaves().select(F.col("node").alias("file_name"))
        return found.where(~manifest.before_boundary(m.model, m.since, F.col("file_name"))) if m.since else found

    def status(self) -> DataFrame:
        return ledger_operators.status(self.files().select("file_name", "checksum"), self.ledger.rows())

    def editable(self) -> DataFrame:
        new = manifest.new_files(self.files(), self.manifest().rows(self.spark))
        failed = ledger_operators.latest(self.ledger.rows()).where("status = 'failed'").join(self.files().select("file_name"), "file_name", "left_semi")
        return manifest.first_reason((self.lasts(), "leaf" if self.manifest().is_graph else "latest"), (new, "new"), (failed, "failed-retryable"))

    def check(self) -> DataFrame:
        """Findings (kind, file_name, detail); none: all is well."""
        m, files = self.manifest(), self.files()
        rows = m.rows(self.spark)
        finding = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "file_name", detail.alias("detail"))
        found = finding(manifest.mismatches(files, rows, self.lasts()), "mismatch", F.concat_ws(" is now ", "expected", "actual"))
        found = found.union(finding(manifest.missing(files, rows).withColumnRenamed("file", "file_name"), "missing", F.lit("recorded, not there")))
        if not m.is_graph:
            found = found.union(finding(manifest.several_new(files, rows), "several-new", F.concat(F.col("new_count").cast("string"), F.lit(" new files"))))
            found = found.union(finding(manifest.mid_sequence(files, rows), "mid-sequence", F.concat(F.lit("sorts before "), "last_key")))
        return found

    def lint(self) -> DataFrame:
        rules = [*lint.RULES, *lint.custom_rules(self.config.path(self.config.rules))]
        return lint.violations(self.files().select("file_name", "sql"), rules, self.config.severity)

    def new(self, name: str, now: datetime | None = None) -> Path:
        """An empty script for the next change."""
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise ValueError(f"{name!r} is not a name of letters, digits and underscores")
        now, naming = now or datetime.now(), self.config.naming
        stamp = self.files().agg(next_serial(F.col("sort_key"), len(naming.timestamp)).alias("s")).first().s if naming.is_serial else None
        at = self.spark.createDataFrame([(now, name, stamp)], "at timestamp, name string, stamp string")
        file = at.select(naming.name(F.col("stamp") if naming.is_serial else naming.stamp(F.col("at")), F.col("name"))).first()[0]
        path = self.config.path(self.config.migrations[0]) / file
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"-- {name}, made {now.astimezone(UTC).isoformat()}\n")
        return path

    def resolve(self, file_name: str) -> None:
        """Settle a failed file as skipped."""
        last = ledger_operators.latest(self.ledger.of_file(file_name)).first()
        if last is None or last.status != "failed":
            raise ValueError(f"{file_name} has not failed")
        self.ledger.append(file_name, last.checksum, "skipped")

    def snapshot(self) -> str:
        text = self.spark.createDataFrame([(0, catalog.dump(self.spark, self.database))], "key int, text string")
        found = snapshot.normalized_text(snapshot.lines(text, "key", "text"), "key").first()
        return found.text if found else ""

    def dump(self) -> Path:
        path = self.config.path(self.config.snapshot)
        path.write_text(self.snapshot())
        return path

    def diff(self) -> DataFrame:
        """Lines of the saved snapshot (left) that differ from the catalog (right)."""
        path = self.config.path(self.config.snapshot)
        texts = self.spark.createDataFrame([(0, path.read_text() if path.exists() else ""), (1, self.snapshot())], "key int, text string")
        rows = snapshot.lines(texts, "key", "text")
        return snapshot.differences(rows.where("key = 0").drop("key"), rows.where("key = 1").drop("key"))

    def apply(self, drift_check: bool = False) -> Applied:
        """Run what is to run, in order; each outcome goes into the ledger. One run at a time. With a drift check, what
        was applied goes into the saved snapshot at the end."""
        out = Applied()
        if not catalog.available(self.spark):
            out.errors.append("the session runs no statements")
            return out
        with self.ledger.lock():
            if drift_check and self.config.path(self.config.snapshot).exists() and not self.diff().isEmpty():
                out.errors.append("the database differs from the saved snapshot")
                return out
            files = self.files().select("file_name", "sort_key", "dir_index", "checksum", "sql")
            is_graph = self.manifest().is_graph
            tree = self.dependencies() if is_graph else None
            last = tree.leaves().select(F.col("node").alias("file_name")) if tree else manifest.tail(files)
            marked = files.join(last.withColumn("editable", F.lit(True)), "file_name", "left").fillna(False, ["editable"])
            actions = {r.file_name: r.action for r in ledger_operators.decisions(marked, self.ledger.rows()).collect()}
            rows = {r.file_name: r for r in files.orderBy("sort_key", "dir_index", "file_name").collect()}
            order = (tree.order() if tree else None) or list(rows)
            dependents: dict[str, list[str]] = {}
            for r in tree.edges.collect() if tree else ():
                dependents.setdefault(r.dst, []).append(r.src)
            blocked: set[str] = set()
            before = self.spark.catalog.currentDatabase()
            self.spark.sql(f"USE {self.database}")
            try:
                for name in order:
                    if name in blocked:
                        out.blocked.append(name)
                        continue
                    if actions[name] in ("skip", "unchanged"):
                        out.skipped.append(name)
                        continue
                    error = catalog.run_script(self.spark, rows[name].sql) if actions[name] in ("execute", "retry", "re-apply") else actions[name]
                    if actions[name] in ("execute", "retry", "re-apply"):
                        self.ledger.append(name, rows[name].checksum, "failed" if error else "applied")
                    if not error:
                        out.applied.append(name)
                        continue
                    out.errors.append(f"{name}: {error}")
                    out.failed = out.failed or name
                    if not is_graph:
                        break
                    above = [name]
                    while above:
                        new = set(dependents.get(above.pop(), ())) - blocked - {name}
                        blocked |= new
                        above += new
            finally:
                self.spark.sql(f"USE {before}")
            if drift_check and out.applied and not out.errors:
                self.dump()
        return out

    def squash(self) -> list[Path]:
        """Join new scripts that depend on each other (all of them without a graph) into one; it is recorded. The joined
        scripts and the manifest are written first, and only then do their sources go."""
        m, files = self.manifest(), self.files()
        new = manifest.new_files(files, m.rows(self.spark))
        if m.is_graph:
            names = new.select(F.col("file_name").alias("src"))
            edges = self.dependencies().edges.join(names, "src", "left_semi").join(names.select(F.col("src").alias("dst")), "dst", "left_semi")
            groups = graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("node").alias("file_name"), "component")
        else:
            groups = new.select("file_name", F.lit("all").alias("component"))
        rows = groups.join(files, "file_name").select("component", "file_name", "sort_key", "description", "sql", "file_path")
        made, sources = [], []
        for group in manifest.squashed(rows).collect():
            own = rows.where(F.col("component") == group.component).orderBy("sort_key").collect()
            name = self.spark.range(1).select(self.config.naming.name(F.lit(own[-1].sort_key), F.lit(group.description))).first()[0]
            sources += [r.file_path for r in own if r.file_name != name]
            path = self.config.path(self.config.migrations[0]) / name
            path.write_text(group.sql)
            made.append(path)
        names = [p.name for p in made]
        sums = {r.file_name: r.checksum for r in self.files().where(F.col("file_name").isin(names)).collect()} if made else {}
        m.entries |= {p.name: sums[p.name] for p in made}
        if made:
            manifest_file.save(m, self.config.path(self.config.manifest))
        for uri in sources:
            delete(self.spark, uri)
        return made

    def verify(self, every: bool = False) -> DataFrame:
        """Run scripts twice in a shadow database: (file_name, passed, first_error, second_error, drift)."""
        files = self.files()
        rows = (files if every else ledger_operators.pending(files, self.ledger.rows())).orderBy("sort_key", "dir_index", "file_name").collect()
        out = []
        with catalog.shadow(self.spark, None if every else self.database) as name:
            for r in rows:
                first = catalog.run_script(self.spark, r.sql)
                before = catalog.dump(self.spark, name) if not first else ""
                second = catalog.run_script(self.spark, r.sql) if not first else None
                drift = bool(not first and not second and catalog.dump(self.spark, name) != before)
                out.append((r.file_name, not (first or second or drift), first, second, drift))
        return self.spark.createDataFrame(out, "file_name string, passed boolean, first_error string, second_error string, drift boolean")
