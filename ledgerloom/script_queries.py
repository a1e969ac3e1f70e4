"""Queries for the statement recogniser, the rules and the graph of scripts: each customer is a script.

The script of customer k is one of a list of templates, by k modulo their number, with k in place of `@`. What each
template should give was written down by hand, from what PostgreSQL says the statements mean; the SQL states it as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.ddl import parsed
from ledgerloom.operators import statements
from ledgerloom.plans import dependencies, lint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Of each rule scripts, and what the rule should find in them: (number of the statement, message).
RULES: dict[str, list[tuple[str, list[tuple[int | None, str]]]]] = {
    "require-concurrent-index": [
        ("CREATE INDEX i ON t@ (a); CREATE INDEX CONCURRENTLY j ON t@ (b)", [(0, "index on t@ blocks writes")]),
        ("CREATE TABLE public.t@ (a int); CREATE UNIQUE INDEX i ON t@ (a); CREATE INDEX k ON other (a)", [(2, "index on other blocks writes")]),
        ("CREATE INDEX i ON s.t@ (a); CREATE TABLE s.t@ (a int)", [(0, "index on s.t@ blocks writes")]),
    ],
    "require-if-not-exists": [
        ("CREATE TABLE t@ (a int); CREATE INDEX CONCURRENTLY i ON t@ (a)", [(0, "statement on t@ fails if it is run again"), (1, "statement on t@ fails if it is run again")]),
        ("CREATE TABLE IF NOT EXISTS t@ (a int); DROP TABLE t@", [(1, "statement on  fails if it is run again")]),
        ("DROP INDEX IF EXISTS i@; CREATE INDEX IF NOT EXISTS i@ ON t@ (a)", []),
    ],
    "require-lock-timeout": [
        ("ALTER TABLE t@ ADD COLUMN a int; DROP TABLE u@", [(0, "DDL without a lock_timeout")]),
        ("SET lock_timeout = '2s'; ALTER TABLE t@ ADD COLUMN a int", []),
        ("CREATE INDEX CONCURRENTLY i ON t@ (a); CREATE INDEX j ON t@ (a)", [(1, "DDL without a lock_timeout")]),
        ("RESET lock_timeout; DROP VIEW v@", []),
    ],
    "ban-concurrent-index-in-transaction": [
        ("BEGIN; CREATE INDEX CONCURRENTLY i ON t@ (a); COMMIT; CREATE INDEX CONCURRENTLY j ON t@ (b)", [(1, "CREATE INDEX CONCURRENTLY on t@ inside a transaction")]),
        ("START TRANSACTION; CREATE INDEX CONCURRENTLY i ON t@ (a)", []),
        ("BEGIN; ROLLBACK; BEGIN; CREATE INDEX i ON t@ (a); CREATE INDEX CONCURRENTLY j ON u@ (a)", [(4, "CREATE INDEX CONCURRENTLY on u@ inside a transaction")]),
    ],
    "adding-not-nullable-field": [
        ("ALTER TABLE t@ ADD COLUMN a int NOT NULL, ADD b int NOT NULL DEFAULT 0, ADD c text", [(0, "NOT NULL column t@.a without a DEFAULT")]),
        ("ALTER TABLE t@ ADD COLUMN IF NOT EXISTS a varchar(20) NOT NULL", [(0, "NOT NULL column t@.a without a DEFAULT")]),
        ("ALTER TABLE t@ ADD COLUMN a int CHECK (a IS NOT NULL)", []),
    ],
    "constraint-missing-not-valid": [
        ("ALTER TABLE t@ ADD CONSTRAINT c@ FOREIGN KEY (a) REFERENCES u (id)", [(0, "constraint c@ on t@ scans the table under a lock")]),
        ("ALTER TABLE t@ ADD CONSTRAINT c@ CHECK (a > 0) NOT VALID, ADD CONSTRAINT d@ CHECK (b > 0)", [(0, "constraint d@ on t@ scans the table under a lock")]),
        ("ALTER TABLE t@ ADD CONSTRAINT u@ UNIQUE (a)", []),
    ],
    "require-analyze-after-index": [
        ("ANALYZE t@; CREATE INDEX i ON t@ (a)", [(1, "no ANALYZE after the index on t@")]),
        ("CREATE INDEX i ON t@ (a); CREATE INDEX j ON u@ (a); VACUUM t@", [(1, "no ANALYZE after the index on u@")]),
        ("CREATE INDEX i ON t@ (a); ANALYZE t@ (a)", []),
    ],
    "require-create-or-replace-view": [
        ("CREATE VIEW v@ AS SELECT a FROM t", [(0, "view v@ can't be created twice")]),
        ("CREATE OR REPLACE VIEW v@ AS SELECT a FROM t; CREATE TEMP VIEW w@ AS SELECT 1", [(1, "view w@ can't be created twice")]),
    ],
    "ban-drop-cascade": [
        ("DROP TABLE IF EXISTS t@ CASCADE", [(0, "DROP ... CASCADE")]),
        ("DROP TABLE t@ RESTRICT; TRUNCATE u@ CASCADE; ALTER TABLE t@ DROP COLUMN a CASCADE", []),
    ],
    "require-statement-timeout": [
        ("DROP TABLE t@; SET statement_timeout = 5", [(0, "DDL without a statement_timeout")]),
        ("SET LOCAL statement_timeout TO 5; DROP TABLE t@", []),
        ("SELECT 1; CREATE TABLE t@ (a int); CREATE TABLE u@ (a int)", [(1, "DDL without a statement_timeout")]),
    ],
    "require-reset-timeouts": [
        ("SET lock_timeout = 1; SET statement_timeout = 1; RESET lock_timeout", [(None, "SET statement_timeout is never RESET")]),
        ("RESET lock_timeout; SET lock_timeout = @", []),
        ("SET statement_timeout TO 5; SET lock_timeout = 1; RESET ALL", []),
        ("SET lock_timeout = @", [(None, "SET lock_timeout is never RESET")]),
    ],
    "ban-truncate": [("TRUNCATE TABLE t@; DELETE FROM t@ WHERE a = 1", [(0, "TRUNCATE t@")]), ("TRUNCATE ONLY s.t@ RESTART IDENTITY", [(0, "TRUNCATE s.t@")]), ("SELECT 'TRUNCATE t@'", [])],
    "ban-update-without-where": [
        ("UPDATE t@ SET a = 1; UPDATE t@ SET a = 2 WHERE b = 3", [(0, "UPDATE of all of t@")]),
        ("UPDATE t@ SET a = (SELECT max(b) FROM u WHERE c = 1)", [(0, "UPDATE of all of t@")]),
        ("-- UPDATE t@ SET a = 1\nSELECT 1", []),
    ],
    "ban-delete-without-where": [
        ("DELETE FROM t@", [(0, "DELETE of all of t@")]),
        ("DELETE FROM t@ USING (SELECT 1 AS x WHERE true) y; DELETE FROM ONLY u@ WHERE a = 1", [(0, "DELETE of all of t@")]),
    ],
    "ban-drop-column": [
        ("ALTER TABLE t@ DROP COLUMN IF EXISTS a, DROP b", [(0, "column t@.a is dropped"), (0, "column t@.b is dropped")]),
        ("ALTER TABLE t@ DROP CONSTRAINT c; ALTER TABLE t@ ALTER COLUMN a DROP DEFAULT", []),
    ],
    "ban-alter-column-type": [
        ("ALTER TABLE t@ ALTER COLUMN a TYPE bigint, ALTER b SET DATA TYPE text", [(0, "type of t@.a changes, which rewrites the table"), (0, "type of t@.b changes, which rewrites the table")]),
        ("ALTER TABLE t@ ALTER COLUMN a SET DEFAULT 1", []),
    ],
    "require-drop-index-concurrently": [("DROP INDEX i@; DROP INDEX CONCURRENTLY j@", [(0, "DROP INDEX blocks the table")]), ("DROP TABLE t@", [])],
    "require-unique-via-concurrent-index": [
        ("ALTER TABLE t@ ADD CONSTRAINT u@ UNIQUE (a)", [(0, "unique constraint u@ builds its index under a lock")]),
        ("ALTER TABLE t@ ADD CONSTRAINT u@ UNIQUE USING INDEX i@", []),
    ],
    "ban-validate-constraint-same-file": [
        ("ALTER TABLE t@ ADD CONSTRAINT c@ CHECK (a > 0) NOT VALID; ALTER TABLE t@ VALIDATE CONSTRAINT c@", [(1, "constraint c@ is validated in the file that adds it")]),
        ("ALTER TABLE t@ VALIDATE CONSTRAINT c@; ALTER TABLE t@ ADD CONSTRAINT c@ CHECK (a > 0) NOT VALID", []),
        ("ALTER TABLE t@ ADD CONSTRAINT c@ CHECK (a > 0) NOT VALID; ALTER TABLE u@ VALIDATE CONSTRAINT c@", []),
    ],
    "ban-bare-analyze": [("ANALYZE; VACUUM t@", [(0, "ANALYZE or VACUUM of the whole database")]), ("ANALYZE t@; VACUUM", [(1, "ANALYZE or VACUUM of the whole database")])],
    "require-if-not-exists-materialized-view": [
        ("CREATE MATERIALIZED VIEW v@ AS SELECT a FROM t", [(0, "materialized view v@ can't be created twice")]),
        ("CREATE MATERIALIZED VIEW IF NOT EXISTS v@ AS SELECT a FROM t; CREATE VIEW w@ AS SELECT 1", []),
    ],
    "ban-refresh-materialized-view-in-migration": [("SELECT 1; REFRESH MATERIALIZED VIEW CONCURRENTLY v@", [(1, "REFRESH MATERIALIZED VIEW")]), ("SELECT @", [])],
    "ban-select-star-in-view": [
        ("CREATE VIEW v@ AS SELECT * FROM t; CREATE VIEW w@ AS SELECT t.*, 1 FROM t", [(0, "view v@ selects *"), (1, "view w@ selects *")]),
        ("CREATE MATERIALIZED VIEW v@ AS SELECT DISTINCT * FROM t", [(0, "view v@ selects *")]),
        ("CREATE VIEW v@ AS SELECT a * b, count(*) FROM (SELECT * FROM t) x", []),
    ],
    "ban-rename-column": [("ALTER TABLE t@ RENAME COLUMN a TO b; ALTER TABLE t@ RENAME a TO b", [(0, "a column of t@ is renamed"), (1, "a column of t@ is renamed")]), ("ALTER TABLE t@ RENAME CONSTRAINT a TO b", [])],
    "ban-rename-table": [("ALTER TABLE IF EXISTS t@ RENAME TO u@", [(0, "table t@ is renamed")]), ("ALTER TABLE t@ RENAME COLUMN a TO b; ALTER INDEX i RENAME TO j", [])],
    "ban-drop-table": [("DROP TABLE IF EXISTS t@, s.u@", [(0, "dropped: t@, s.u@")]), ("DROP VIEW t@", [])],
    "require-pk-via-concurrent-index": [
        ("ALTER TABLE t@ ADD PRIMARY KEY (a)", [(0, "primary key on t@ builds its index under a lock")]),
        ("ALTER TABLE t@ ADD CONSTRAINT p PRIMARY KEY USING INDEX i@", []),
    ],
    "ban-set-not-null": [("ALTER TABLE t@ ALTER COLUMN a SET NOT NULL", [(0, "SET NOT NULL on t@.a scans the table")]), ("ALTER TABLE t@ ALTER COLUMN a DROP NOT NULL", [])],
    "ban-alter-enum-in-transaction": [
        ("BEGIN; ALTER TYPE e@ ADD VALUE 'x'; COMMIT; ALTER TYPE e@ ADD VALUE 'y'", [(1, "value of e@ added inside a transaction")]),
        ("ALTER TYPE e@ ADD VALUE IF NOT EXISTS 'x'", []),
    ],
    "ban-vacuum-full": [
        ("VACUUM FULL t@; VACUUM t@", [(0, "VACUUM FULL rewrites the table under a lock")]),
        ("VACUUM (FULL, VERBOSE) t@", [(0, "VACUUM FULL rewrites the table under a lock")]),
        ("VACUUM (VERBOSE) t@; ANALYZE t@", []),
    ],
    "ban-cluster": [("CLUSTER t@ USING i@", [(0, "CLUSTER rewrites the table under a lock")]), ("SELECT @", [])],
    "ban-reindex": [("REINDEX TABLE t@", [(0, "REINDEX blocks the table")]), ("CREATE INDEX reindex ON t@ (a)", [])],
    "ban-alter-system": [("ALTER SYSTEM SET work_mem = '1GB'", [(0, "ALTER SYSTEM")]), ("SET work_mem = '1GB'; ALTER TABLE system ADD a int", [])],
    "ban-set-session-replication-role": [("SET session_replication_role = replica; RESET session_replication_role", [(0, "session_replication_role is changed"), (1, "session_replication_role is changed")]), ("SET lock_timeout = @", [])],
}

#: Scripts, the statements that they hold (kind, relation; none where one of them isn't SQL), and the objects that each
#: statement creates and refers to.
SCRIPTS: list[tuple[str, list[tuple[str, str, list[tuple[str, str]], list[tuple[str, str]]]]]] = [
    (
        "CREATE TABLE public.t@ (id bigint PRIMARY KEY, a int REFERENCES u@ (id), b int, CONSTRAINT f FOREIGN KEY (b) REFERENCES s.w@ (id)); -- end\nSELECT 1;",
        [("create-table", "t@", [("table", "t@")], [("table", "u@"), ("table", "s.w@")]), ("other", "", [], [])],
    ),
    ("CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS i@ ON ONLY s.t@ USING btree (lower(a)) WHERE a > 0", [("index", "s.t@", [], [("table", "s.t@")])]),
    (
        "ALTER TABLE IF EXISTS ONLY t@ ADD COLUMN a int REFERENCES u@, ADD CONSTRAINT f FOREIGN KEY (b) REFERENCES \"W@\" (id) NOT VALID",
        [("alter-table", "t@", [], [("table", "t@"), ("table", "u@"), ("table", "W@")])],
    ),
    (
        "CREATE OR REPLACE VIEW v@ AS WITH q AS (SELECT 1 FROM x@) SELECT a FROM q JOIN s.y@ ON true WHERE b IN (SELECT c FROM public.z@)",
        [("view", "v@", [("view", "v@")], [("table", "x@"), ("table", "q"), ("table", "s.y@"), ("table", "z@")])],
    ),
    ("DROP TABLE IF EXISTS t@, s.u@ CASCADE; DROP VIEW v@; DROP INDEX i@", [("drop", "", [], [("table", "t@"), ("table", "s.u@")]), ("drop", "", [], [("view", "v@")]), ("drop", "", [], [("index", "i@")])]),
    ("CREATE FUNCTION f@(a int) RETURNS int AS $body$ SELECT 1; SELECT ';' $body$ LANGUAGE sql; CREATE PROCEDURE s.p@() LANGUAGE sql AS 'SELECT 1;'", [("function", "f@", [("function", "f@")], []), ("function", "s.p@", [("function", "s.p@")], [])]),
    ("CREATE TABLE t@ (a int); SELEC 1", []),
    ("CREATE TABLE t@ (a int; SELECT 1", []),
    ("ALTER TABLE t@ FROB; SELECT 1", []),
    ("INSERT INTO; SELECT 1", []),
    ("SELECT a FROM WHERE b = @", []),
    ("/* nothing /* at */ all */ ;; -- @", []),
    ("INSERT INTO t@ VALUES ('a;b', $$;$$); UPDATE t@ SET a = 1 WHERE b = 2", [("other", "", [], []), ("update", "t@", [], [])]),
]


def add(name: str, sql: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], SQL[name] = run, sql


def scripts(spark: SparkSession, folder: str, templates: Sequence[str]) -> DataFrame:
    """(file_name, sql): a script for each customer."""
    key = F.col("c_custkey")
    texts = F.array(*map(F.lit, templates))
    chosen = F.element_at(texts, (key % len(templates) + 1).cast("int"))
    return spark.read.parquet(f"{folder}/customer.parquet").select(key.cast("string").alias("file_name"), F.replace(chosen, F.lit("@"), key.cast("string")).alias("sql"))


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _expected(templates: int, rows: list[tuple], columns: tuple[str, ...], types: tuple[str, ...]) -> str:
    """SQL for the rows (number of a template, value, ...), `@` filled in, of all customers."""
    values = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows) if rows else f"({', '.join(['-1'] + ['NULL'] * len(columns))})"
    filled = ", ".join(f"replace({c}, '@', CAST(c_custkey AS VARCHAR)) AS {c}" if t == "VARCHAR" else f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns, types, strict=True))
    return f"SELECT CAST(c_custkey AS VARCHAR) AS file_name, {filled} FROM customer JOIN (VALUES {values}) AS e(template, {', '.join(columns)}) ON c_custkey % {templates} = e.template"


def _rule(rule: lint.Rule) -> None:
    cases = RULES[rule.id]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return lint.violations(scripts(spark, folder, [sql for sql, _ in cases]), [rule]).select("file_name", F.col("ord"), "message")

    rows = [(k, ord_, message) for k, (_, hits) in enumerate(cases) for ord_, message in hits]
    add("rule_" + rule.id.replace("-", "_"), _expected(len(cases), rows, ("ord", "message"), ("INTEGER", "VARCHAR")), run)


for _each in lint.RULES:
    _rule(_each)


def _script_rows(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(scripts(spark, folder, [sql for sql, _ in SCRIPTS]))


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of statements; a script with a mistake anywhere gives none."""
    return _script_rows(spark, folder).where("error is null").select("file_name", "ord", "kind", "relation")


def _failed(spark: SparkSession, folder: str) -> DataFrame:
    return _script_rows(spark, folder).where("error is not null").select("file_name")


def _objects(column: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = _script_rows(spark, folder).select("file_name", "ord", F.posexplode(column).alias("n", "o"))
        return rows.select("file_name", "ord", "n", F.col("o.type").alias("type"), F.col("o.name").alias("name"))

    return run


_FAIL = [k for k, (sql, found) in enumerate(SCRIPTS) if not found and not sql.startswith("/*")]
add("parse_statements", _expected(len(SCRIPTS), [(k, n, s[0], s[1]) for k, (_, found) in enumerate(SCRIPTS) for n, s in enumerate(found)], ("ord", "kind", "relation"), ("INTEGER", "VARCHAR", "VARCHAR")), _statements)
add("parse_failures", f"SELECT CAST(c_custkey AS VARCHAR) AS file_name FROM customer WHERE c_custkey % {len(SCRIPTS)} IN ({', '.join(map(str, _FAIL))})", _failed)
for _name, _at in (("creates", 2), ("refs", 3)):
    _rows = [(k, n, m, kind, name) for k, (_, found) in enumerate(SCRIPTS) for n, s in enumerate(found) for m, (kind, name) in enumerate(s[_at])]
    add(f"extract_{_name}", _expected(len(SCRIPTS), _rows, ("ord", "n", "type", "name"), ("INTEGER", "INTEGER", "VARCHAR", "VARCHAR")), _objects(_name))


#: One script of each rule, with a directive that allows half of what it breaks.
_MIXED = [
    ("-- loom:allow ban-truncate, ban-cluster\nTRUNCATE t@; CLUSTER t@; REINDEX TABLE t@", 1, 0),
    ("TRUNCATE t@; DELETE FROM t@; UPDATE t@ SET a = 1", 2, 1),
    ("-- loom:allow ban-reindex\nREINDEX TABLE t@", 0, 0),
    ("REINDEX TABLE t@; VACUUM FULL t@", 1, 0),
]
_SEVERITY = {"ban-truncate": "warn", "ban-vacuum-full": "off"}
_MIXED_RULES = ("ban-truncate", "ban-cluster", "ban-reindex", "ban-delete-without-where", "ban-update-without-where", "ban-vacuum-full")


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    rules = [r for r in lint.RULES if r.id in _MIXED_RULES]
    return lint.violations(scripts(spark, folder, [m[0] for m in _MIXED]), rules, _SEVERITY)


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    """Errors and warnings of each script that has any, and of all together (no name)."""
    return statements.severity_totals(_mixed(spark, folder), "file_name")


_each_file = " UNION ALL ".join(f"SELECT {k} AS template, {e} AS errors, {w} AS warnings" for k, (_, e, w) in enumerate(_MIXED))
add(
    "lint_totals",
    f"""WITH e AS ({_each_file}), f AS (SELECT CAST(c_custkey AS VARCHAR) AS file_name, errors, warnings FROM customer JOIN e ON c_custkey % {len(_MIXED)} = template WHERE errors + warnings > 0)
    SELECT file_name, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings FROM f UNION ALL SELECT NULL, CAST(sum(errors) AS BIGINT), CAST(sum(warnings) AS BIGINT) FROM f""",
    _totals,
)


# a graph of scripts: groups of ten, each script refers to the one before and declares the first of its group


def _graph_files(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(
        F.when(k % 10 > 1, F.concat(F.lit("-- loom:depends-on "), (k - k % 10).cast("string"), F.lit("\n"))).otherwise(""),
        F.concat(F.lit("CREATE TABLE t"), k.cast("string"), F.lit(" (id bigint")),
        F.when(k % 10 > 0, F.concat(F.lit(", a bigint REFERENCES t"), (k - 1).cast("string"))).otherwise(""),
        F.lit("); ALTER TABLE t"),
        k.cast("string"),
        F.lit(" ADD b int"),
    )
    rows = spark.read.parquet(f"{folder}/customer.parquet")
    return rows.select(k.cast("string").alias("file_name"), F.lpad(k.cast("string"), 12, "0").alias("sort_key"), F.lit(0).alias("dir_index"), text.alias("sql"))


_IN_GROUP = "c_custkey % 10 > 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer)"
_GRAPH = f"""edges AS (SELECT c_custkey AS s, c_custkey - 1 AS d, 't' || (c_custkey - 1) AS via FROM customer WHERE {_IN_GROUP}
    UNION ALL SELECT c_custkey, c_custkey - c_custkey % 10, 'explicit' FROM customer WHERE c_custkey % 10 > 1 AND c_custkey - c_custkey % 10 IN (SELECT c_custkey FROM customer))"""


def _tree(spark: SparkSession, folder: str) -> dependencies.Dependencies:
    return dependencies.build(_graph_files(spark, folder))


add("script_edges", f"WITH {_GRAPH} SELECT CAST(s AS VARCHAR) AS src, CAST(d AS VARCHAR) AS dst, via FROM edges", lambda spark, d: _tree(spark, d).edges)
add(
    "script_graph_counts",
    f"WITH {_GRAPH} SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT d FROM edges)) AS leaves",
    lambda spark, d: _tree(spark, d).counts(),
)
add(
    "script_dependents",
    "SELECT CAST(c_custkey AS VARCHAR) AS node FROM customer WHERE c_custkey BETWEEN 21 AND 29",
    lambda spark, d: _tree(spark, d).dependents("20"),
)
_ROOTED = "x AS (SELECT c_custkey AS k, CASE WHEN c_custkey - c_custkey % 10 IN (SELECT c_custkey FROM customer) THEN c_custkey - c_custkey % 10 ELSE c_custkey - c_custkey % 10 + 1 END AS root FROM customer)"
add(
    "script_tree",
    f"""WITH {_ROOTED} SELECT CAST(row_number() OVER (ORDER BY CAST(root AS VARCHAR), k) - 1 AS INTEGER) AS pos,
    CASE WHEN k = root THEN '' ELSE repeat('    ', CAST(k - root - 1 AS INTEGER)) || '└── ' END || k AS line FROM x""",
    lambda spark, d: _tree(spark, d).tree_rows().select(F.col("pos").cast("int").alias("pos"), "line"),
)
add(
    "script_trunk",
    """WITH s AS (SELECT CAST(min(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS k FROM customer WHERE c_custkey % 10 = 9 AND c_custkey - 9 IN (SELECT c_custkey FROM customer))
    SELECT CAST(k - n AS VARCHAR) AS node, CAST(n AS INTEGER) AS step FROM s, range(10) t(n)""",
    lambda spark, d: spark.createDataFrame([(n, k) for k, n in enumerate(_tree(spark, d).trunk())], "node string, step int"),
)
