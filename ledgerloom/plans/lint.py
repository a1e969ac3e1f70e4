"""Rules over parsed statements, evaluated together: context once, then all rules that look at one statement in one pass.

A rule of one statement is an expression that gives an array of messages; rules over a whole file are DataFrame functions
(file_name, ord, message). Custom rules are of either kind.
"""

from __future__ import annotations

import importlib.util
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ddl import parsed
from ledgerloom.functions.sqltext import allowed_rules
from ledgerloom.operators import statements
from ledgerloom.storage import settled


@dataclass(frozen=True)
class Rule:
    id: str
    hint: str
    row: Callable[[], Column] | None = None
    file: Callable[[DataFrame], DataFrame] | None = None


def kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def when(condition: Column, message: str) -> Column:
    """The message, with {relation} filled in, if the condition holds."""
    text = F.replace(F.lit(message), F.lit("{relation}"), F.coalesce("relation", F.lit("")))
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def commands(condition: Callable[[Column], Column], message: str) -> Column:
    """A message for each command of ALTER TABLE that the condition holds for; {name} is the command's."""
    text = F.replace(F.lit(message), F.lit("{relation}"), F.coalesce("relation", F.lit("")))
    hits = F.filter("commands", condition)
    return F.when(kind("alter-table"), F.transform(hits, lambda c: F.replace(text, F.lit("{name}"), c["name"]))).otherwise(F.array().cast("array<string>"))


def with_context(rows: DataFrame, sets: bool = False) -> DataFrame:
    """Running state: whether the relation was created so far, whether timeouts were set, whether inside a transaction,
    and first hits. With `sets`, also all tables created so far, as an array in each row."""
    locks = kind("create-table", "alter-table", "drop") | (kind("index") & ~F.col("concurrent"))
    rows = rows.withColumn("table", F.element_at(F.split("relation", r"\."), -1))
    if sets:
        rows = rows.withColumn("created", F.collect_set(F.when(kind("create-table"), F.col("table"))).over(statements.so_far()))
    rows = rows.withColumns({
        "own_table": statements.created_so_far(kind("create-table"), "table"),
        "lock_timeout_set": statements.latch(kind("set", "reset") & (F.col("setting") == "lock_timeout")),
        "statement_timeout_set": statements.latch(kind("set") & (F.col("setting") == "statement_timeout")),
        "in_transaction": statements.toggle(kind("begin"), kind("commit")),
    })
    return rows.withColumns({"first_unlocked": statements.first_of(locks & ~F.col("lock_timeout_set")), "first_untimed": statements.first_of(locks & ~F.col("statement_timeout_set"))})


def _without_analyze(rows: DataFrame) -> DataFrame:
    analyzed = rows.where(kind("analyze", "vacuum")).select("file_name", "ord", F.explode("names").alias("relation"), F.lit(False).alias("builds"))
    built = rows.where(kind("index")).select("file_name", "ord", "relation", F.lit(True).alias("builds"))
    found = statements.needs_follow_up(built.union(analyzed), F.col("builds"), ~F.col("builds"), "relation")
    return found.select("file_name", F.col("started").alias("ord"), F.concat(F.lit("no ANALYZE after the index on "), "relation").alias("message"))


def _without_reset(rows: DataFrame) -> DataFrame:
    names = F.array(F.lit("lock_timeout"), F.lit("statement_timeout"))
    each = rows.where(kind("set", "reset")).select("file_name", "kind", "setting", F.explode(names).alias("timeout"))
    left = each.groupBy("file_name", "timeout").agg(F.bool_or(kind("set") & (F.col("setting") == F.col("timeout"))).alias("on"), F.bool_or(kind("reset") & F.col("setting").isin("all", F.col("timeout"))).alias("off"))
    return left.where("on and not off").select("file_name", F.lit(None).cast("int").alias("ord"), F.concat(F.lit("SET "), "timeout", F.lit(" is never RESET")).alias("message"))


def _validated_at_once(rows: DataFrame) -> DataFrame:
    each = rows.where(kind("alter-table")).select("file_name", "relation", (F.col("ord") * 1000).alias("base"), F.posexplode("commands").alias("n", "c"))
    each = each.select("file_name", "relation", (F.col("base") + F.col("n")).alias("ord"), F.col("c.name").alias("name"), F.col("c.action").alias("action"), "c.not_valid")
    seen = each.withColumn("added", statements.seen_before((F.col("action") == "add-constraint") & F.col("not_valid"), "relation", "name"))
    return seen.where("added and action = 'validate'").select("file_name", F.floor(F.col("ord") / 1000).cast("int").alias("ord"), F.concat(F.lit("constraint "), "name", F.lit(" is validated in the file that adds it")).alias("message"))


def _added(kinds: tuple[str, ...], condition: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: (c["action"] == "add-constraint") & c["constraint"].isin(*kinds) & condition(c)


def _action(name: str) -> Callable[[Column], Column]:
    return lambda c: c["action"] == name


def _view_star() -> Column:
    return when(kind("view", "materialized-view") & F.col("star"), "view {relation} selects *")


RULES: tuple[Rule, ...] = (
    Rule("require-concurrent-index", "use CREATE INDEX CONCURRENTLY on a table that is in use", lambda: when(kind("index") & ~F.col("concurrent") & ~F.col("own_table"), "index on {relation} blocks writes")),
    Rule("require-if-not-exists", "add IF NOT EXISTS or IF EXISTS, so the script can run again", lambda: when(kind("create-table", "index", "drop") & ~F.col("if_exists"), "statement on {relation} fails if it is run again")),
    Rule("require-lock-timeout", "SET lock_timeout before the first DDL statement", lambda: when(F.col("first_unlocked"), "DDL without a lock_timeout")),
    Rule("ban-concurrent-index-in-transaction", "run it outside BEGIN and COMMIT", lambda: when(kind("index") & F.col("concurrent") & F.col("in_transaction"), "CREATE INDEX CONCURRENTLY on {relation} inside a transaction")),
    Rule("adding-not-nullable-field", "give the column a DEFAULT, or add it nullable first", lambda: commands(lambda c: (c["action"] == "add-column") & c["not_null"] & ~c["has_default"], "NOT NULL column {relation}.{name} without a DEFAULT")),
    Rule("constraint-missing-not-valid", "add it NOT VALID and validate it in a later script", lambda: commands(_added(("foreign", "check"), lambda c: ~c["not_valid"]), "constraint {name} on {relation} scans the table under a lock")),
    Rule("require-analyze-after-index", "ANALYZE the table after building the index", file=_without_analyze),
    Rule("require-create-or-replace-view", "use CREATE OR REPLACE VIEW", lambda: when(kind("view") & ~F.col("replace"), "view {relation} can't be created twice")),
    Rule("ban-drop-cascade", "drop dependent objects by name", lambda: when(kind("drop") & F.col("cascade"), "DROP ... CASCADE")),
    Rule("require-statement-timeout", "SET statement_timeout before the first DDL statement", lambda: when(F.col("first_untimed"), "DDL without a statement_timeout")),
    Rule("require-reset-timeouts", "RESET the timeout at the end of the script", file=_without_reset),
    Rule("ban-truncate", "delete rows by condition, in another tool", lambda: when(kind("truncate"), "TRUNCATE {relation}")),
    Rule("ban-update-without-where", "add a WHERE clause", lambda: when(kind("update") & ~F.col("has_where"), "UPDATE of all of {relation}")),
    Rule("ban-delete-without-where", "add a WHERE clause", lambda: when(kind("delete") & ~F.col("has_where"), "DELETE of all of {relation}")),
    Rule("ban-drop-column", "stop using the column first", lambda: commands(_action("drop-column"), "column {relation}.{name} is dropped")),
    Rule("ban-alter-column-type", "add a column of the new type and move over", lambda: commands(_action("alter-type"), "type of {relation}.{name} changes, which rewrites the table")),
    Rule("require-drop-index-concurrently", "use DROP INDEX CONCURRENTLY", lambda: when(kind("drop") & (F.col("object_type") == "index") & ~F.col("concurrent"), "DROP INDEX blocks the table")),
    Rule("require-unique-via-concurrent-index", "build a unique index concurrently and add the constraint USING INDEX", lambda: commands(_added(("unique",), lambda c: ~c["using_index"]), "unique constraint {name} builds its index under a lock")),
    Rule("ban-validate-constraint-same-file", "validate it in a later script", file=_validated_at_once),
    Rule("ban-bare-analyze", "name the tables", lambda: when(kind("analyze", "vacuum") & (F.size("names") == 0), "ANALYZE or VACUUM of the whole database")),
    Rule("require-if-not-exists-materialized-view", "add IF NOT EXISTS", lambda: when(kind("materialized-view") & ~F.col("if_exists"), "materialized view {relation} can't be created twice")),
    Rule("ban-refresh-materialized-view-in-migration", "refresh it on a schedule", lambda: when(kind("refresh"), "REFRESH MATERIALIZED VIEW")),
    Rule("ban-select-star-in-view", "name the columns", _view_star),
    Rule("ban-rename-column", "add a column and move over", lambda: when(kind("rename") & (F.col("object_type") == "column"), "a column of {relation} is renamed")),
    Rule("ban-rename-table", "keep the name, or put a view in its place", lambda: when(kind("rename") & (F.col("object_type") == "table"), "table {relation} is renamed")),
    Rule("ban-drop-table", "stop using the table first", lambda: F.when(kind("drop") & (F.col("object_type") == "table"), F.array(F.concat(F.lit("dropped: "), F.array_join("names", ", ")))).otherwise(F.array().cast("array<string>"))),
    Rule("require-pk-via-concurrent-index", "build a unique index concurrently and add the key USING INDEX", lambda: commands(_added(("primary",), lambda c: ~c["using_index"]), "primary key on {relation} builds its index under a lock")),
    Rule("ban-set-not-null", "add a CHECK constraint NOT VALID and validate it first", lambda: commands(_action("set-not-null"), "SET NOT NULL on {relation}.{name} scans the table")),
    Rule("ban-alter-enum-in-transaction", "run it outside BEGIN and COMMIT", lambda: when(kind("alter-enum") & F.col("in_transaction"), "value of {relation} added inside a transaction")),
    Rule("ban-vacuum-full", "VACUUM without FULL", lambda: when(kind("vacuum") & F.array_contains("options", "full"), "VACUUM FULL rewrites the table under a lock")),
    Rule("ban-cluster", "rewrite the table with an online tool", lambda: when(kind("cluster"), "CLUSTER rewrites the table under a lock")),
    Rule("ban-reindex", "reindex concurrently, outside of scripts", lambda: when(kind("reindex"), "REINDEX blocks the table")),
    Rule("ban-alter-system", "change settings with the server's own tools", lambda: when(kind("alter-system"), "ALTER SYSTEM")),
    Rule("ban-set-session-replication-role", "leave triggers and foreign keys on", lambda: when(kind("set", "reset") & (F.col("setting") == "session_replication_role"), "session_replication_role is changed")),
)


def custom_rules(folder: str | Path) -> list[Rule]:
    """The RULES of each Python module in a folder; one that can't be loaded is warned of. No folder: none."""
    found = []
    for path in sorted(Path(folder).glob("*.py")) if Path(folder).is_dir() else []:
        spec = importlib.util.spec_from_file_location(f"ledgerloom_rules_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
        except Exception as e:  # whatever a stranger's module raises
            warnings.warn(f"rules of {path} can't be loaded: {e}", stacklevel=2)
            continue
        found += [r for r in getattr(module, "RULES", ()) if isinstance(r, Rule)]
    return found


def violations(files: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, severity: dict[str, str] | None = None, tool: str = "loom") -> DataFrame:
    """`files` (file_name, sql): rows (file_name, ord, rule, severity, message, hint). Files that aren't recognised give none.

    severity: of rules by id: error (also those that aren't named), warn or off.
    """
    spark = files.sparkSession
    severity = severity or {}
    active = [r for r in rules if severity.get(r.id) != "off"]
    schema = "file_name string, ord int, rule string, message string"
    if not active:
        return spark.createDataFrame([], schema + ", severity string, hint string").select("file_name", "ord", "rule", "severity", "message", "hint")
    # parsed once, whatever the number of rules; those of one statement are one pass, and the state that none asks for goes
    own = {r.id for r in RULES}
    rows = with_context(parsed(files).where("error is null"), sets=any(r.id not in own for r in active))
    if any(r.file for r in active):
        rows = settled(rows)
    single = [F.struct(F.lit(r.id).alias("rule"), r.row().alias("messages")) for r in active if r.row]
    found = spark.createDataFrame([], schema)
    if single:
        each = rows.select("file_name", "ord", F.explode(F.array(*single)).alias("hit"))
        found = found.union(each.select("file_name", "ord", "hit.rule", F.explode("hit.messages").alias("message")))
    for r in active:
        if r.file:
            found = found.union(r.file(rows).select("file_name", "ord", F.lit(r.id).alias("rule"), "message"))
    allowed = files.select(F.col("file_name").cast("string").alias("file_name"), F.explode(allowed_rules(F.col("sql"), tool)).alias("rule")).distinct()
    kinds = F.create_map(*(F.lit(x) for r in active for x in (r.id, "warn" if severity.get(r.id) == "warn" else "error")))
    hints = F.create_map(*(F.lit(x) for r in active for x in (r.id, r.hint)))
    return statements.not_allowed(found, allowed).select("file_name", "ord", "rule", kinds[F.col("rule")].alias("severity"), "message", hints[F.col("rule")].alias("hint"))


def parse_errors(files: DataFrame) -> DataFrame:
    return parsed(files).where("error is not null").select("file_name", "error")

