"""python -m ledgerloom.cli COMMAND: the commands over the project around the current folder. Exit code 1 on findings."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.naming import padded
from ledgerloom.operators import ledger, statements
from ledgerloom.plans.project import Project


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    parser.add_argument("--root", default=".")
    parser.add_argument("--database", default="default")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "squash", "lint", "dump", "diff", "status", "editable"):
        commands.add_parser(name)
    commands.add_parser("new").add_argument("name")
    commands.add_parser("resolve").add_argument("file")
    commands.add_parser("apply").add_argument("--with-drift-check", action="store_true")
    commands.add_parser("verify").add_argument("--all", action="store_true")
    commands.add_parser("deps").add_argument("--html")
    given = parser.parse_args(args)
    project = Project(spark or SparkSession.builder.getOrCreate(), given.root, given.database)
    try:
        return _run(project, given)
    except (ValueError, TimeoutError) as e:
        print(e, file=sys.stderr)
        return 1


def _show(rows) -> list:
    found = rows.collect()
    for r in found:
        print(" | ".join("" if x is None else str(x) for x in r))
    return found


def _run(project: Project, given: argparse.Namespace) -> int:
    match given.command:
        case "new":
            print(project.new(given.name))
        case "apply":
            done = project.apply(given.with_drift_check)
            print("\n".join([f"applied {n}" for n in done.applied] + [f"blocked {n}" for n in done.blocked] + done.errors))
            return int(bool(done.errors))
        case "check":
            return int(bool(_show(project.check())))
        case "squash":
            print("\n".join(map(str, project.squash())))
        case "lint":
            found = project.lint()
            _show(found.orderBy("file_name", "ord", "rule"))
            totals = {r.file_name: (r.errors, r.warnings) for r in statements.severity_totals(found, "file_name").collect()}
            errors, warnings = totals.get(None, (0, 0))
            print(f"{errors} errors, {warnings} warnings")
            return int(errors > 0)
        case "dump":
            print(project.dump())
        case "diff":
            return int(bool(_show(project.diff().orderBy("pos"))))
        case "status":
            found = project.status()
            _show(found.select(padded(F.col("status"), 12), "file_name", "checksum", "applied_at").orderBy("file_name"))
            print(", ".join(f"{n} {k}" for k, n in ledger.status_counts(found).first().asDict().items()))
        case "resolve":
            project.resolve(given.file)
        case "editable":
            _show(project.editable().orderBy("file_name"))
        case "verify":
            found = project.verify(given.all)
            _show(found)
            count = statements.passed_counts(found).first()
            print(f"{count.passed} passed, {count.failed} failed")
            return int(count.failed > 0)
        case "deps":
            tree = project.dependencies()
            print("\n".join(tree.tree()))
            if given.html:
                with open(given.html, "w") as f:
                    f.write(tree.html())
            paths = tree.cycle_paths()
            for path in paths:
                print("cycle: " + " -> ".join(path))
            count = tree.counts().first()
            print(f"{count.nodes} files, {count.edges} dependencies, {count.leaves} leaves")
            return int(bool(paths))
    return 0


if __name__ == "__main__":
    sys.exit(main())
