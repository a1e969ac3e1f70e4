"""Queries for sources and sinks: each writes what nations and regions make, in the shared folder or the catalog, and
reads it back. The number of files and tables is that of nations or regions, so the driver makes them one by one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.naming import padded, short_name
from ledgerloom.operators import ledger as ledger_operators
from ledgerloom.operators import manifest as manifest_operators
from ledgerloom.operators import statements
from ledgerloom.sources import catalog, manifest, scripts
from ledgerloom.sources.ledger import Ledger
from ledgerloom.storage import shared_folder, write_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/project-{uuid.uuid4().hex}"


def _regions(spark: SparkSession, folder: str) -> list:
    return spark.read.parquet(f"{folder}/region.parquet").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).orderBy("k").collect()


@query("""WITH n AS (SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS s FROM nation)
    SELECT '20260101_' || s || '__n ' || k || '.sql' AS file_name, CAST(k % 2 AS INTEGER) AS dir_index, '20260101_' || s AS sort_key, 'n ' || k AS description, sha256('CREATE TABLE n' || k || ' (a int) ;') AS checksum
    FROM n WHERE k % 5 <> 0 AND k % 7 <> 0""")
def script_scan(spark, d):
    """Two folders, besides one that isn't there; names that don't fit and other endings are left out."""
    root = _folder(spark)
    for r in spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k")).collect():
        name = f"notes {r.k}.sql" if r.k % 5 == 0 else f"20260101_{r.k:06}__n {r.k}" + (".txt" if r.k % 7 == 0 else ".sql")
        write_text(spark, f"{root}/{'ab'[r.k % 2]}/{name}", f"-- nation {r.k}\nCREATE TABLE n{r.k}\n  (a int) /* all */;\n")
    found = scripts.scan(spark, [f"{root}/a", f"{root}/b", f"{root}/none"])
    return found.select("file_name", "dir_index", "sort_key", "description", "checksum")


def _ledger(spark: SparkSession, d: str) -> Ledger:
    table = Ledger(spark, f"{_folder(spark)}/ledger")
    for r in _regions(spark, d):
        table.append(r.name if r.k != 3 else "again", f"c{r.k}", ("applied", "failed", "skipped")[r.k % 3])
    table.append("again", "c9", "failed")
    return table


_LEDGER = """l AS (SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS id, CASE r_regionkey WHEN 3 THEN 'again' ELSE r_name END AS file_name, 'c' || r_regionkey AS checksum,
    CASE r_regionkey % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status FROM region UNION ALL SELECT count(*) + 1, 'again', 'c9', 'failed' FROM region)"""


@query(f"WITH {_LEDGER} SELECT id, file_name, checksum, status, status = 'skipped' AS resolved FROM l")
def ledger_append(spark, d):
    return _ledger(spark, d).ordered().select("id", "file_name", "checksum", "status", F.col("resolved_at").isNotNull().alias("resolved"))


@query(f"WITH {_LEDGER} SELECT id, checksum FROM l WHERE file_name = 'again'")
def ledger_lookup(spark, d):
    return _ledger(spark, d).of_file("again").select("id", "checksum")


@query(f"WITH {_LEDGER} SELECT DISTINCT file_name FROM l WHERE status IN ('applied', 'skipped')")
def ledger_applied(spark, d):
    return _ledger(spark, d).applied()


@query("SELECT r_name AS file, 'c' || r_regionkey AS checksum, 'dag' AS model, r_name < 'B' AS before_boundary FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'new', 'c', 'dag', false")
def manifest_round_trip(spark, d):
    """Written, changed and read back: a row added, one taken out."""
    path = f"{_folder(spark)}/manifest.json"
    manifest.save(manifest.Manifest({r.name: f"c{r.k}" for r in _regions(spark, d)}, "dag", "B"), path)
    before = manifest.load(path)
    gone = next(r.name for r in _regions(spark, d) if r.k == 1)
    rows = manifest_operators.put(manifest_operators.remove(before.rows(spark), gone), spark.createDataFrame([("new", "c")], "file string, checksum string"))
    manifest.save(manifest.Manifest({r.file: r.checksum for r in rows.collect()}, before.model, before.since), path)
    m = manifest.load(path)
    return m.rows(spark).select("file", "checksum", F.lit("dag" if m.is_graph else None).alias("model"), manifest_operators.before_boundary(m.model, m.since, F.col("file")).alias("before_boundary"))


def _tables(spark: SparkSession, d: str) -> str:
    return "\n".join(f"CREATE TABLE r{r.k} (id BIGINT, name STRING) USING parquet;" for r in _regions(spark, d))


@query("""WITH t AS (SELECT r_regionkey AS k, unnest([0, 1, 2, 3, 4]) AS n FROM region)
    SELECT CAST(row_number() OVER (ORDER BY k, n) - 1 AS INTEGER) AS pos, CASE n WHEN 0 THEN 'CREATE TABLE r' || k || ' (' WHEN 1 THEN '  id BIGINT,' WHEN 2 THEN '  name STRING)' WHEN 3 THEN 'USING parquet;' ELSE '' END AS line
    FROM t WHERE NOT (n = 4 AND k = (SELECT max(r_regionkey) FROM region))""")
def catalog_dump(spark, d):
    """The tables of a database made by a script, as text."""
    with catalog.shadow(spark) as name:
        error = catalog.run_script(spark, _tables(spark, d))
        text = error or catalog.dump(spark, name)
    return spark.createDataFrame(list(enumerate(line.replace(f"spark_catalog.{name}.", "").replace("spark_catalog.", "") for line in text.rstrip("\n").split("\n"))), "pos int, line string")


@query("SELECT 'r' || r_regionkey AS name, true AS cloned FROM region")
def shadow_clone(spark, d):
    """Empty copies of a database's tables in a database that is gone afterwards."""
    with catalog.shadow(spark) as source:
        catalog.run_script(spark, _tables(spark, d))
        with catalog.shadow(spark, source) as name:
            cloned = [(t.name, spark.table(f"{name}.{t.name}").columns == ["id", "name"]) for t in spark.catalog.listTables(name)]
        gone = not spark.catalog.databaseExists(name)
    return spark.createDataFrame([(n, ok and gone) for n, ok in cloned], "name string, cloned boolean")


@query("SELECT CAST(r_regionkey AS INTEGER) AS k, r_regionkey % 2 = 0 AS ran, CASE WHEN r_regionkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS tables FROM region")
def script_run(spark, d):
    """Scripts run statement by statement, up to the first that fails."""
    rows = []
    for r in _regions(spark, d):
        with catalog.shadow(spark) as name:
            error = catalog.run_script(spark, f"CREATE TABLE a (x STRING) USING parquet; {'' if r.k % 2 == 0 else 'CREATE NONSENSE;'} CREATE TABLE b (x INT DEFAULT 1) USING parquet -- ;")
            rows.append((r.k, error is None and catalog.available(spark), ",".join(sorted(t.name for t in spark.catalog.listTables(name)))))
    return spark.createDataFrame(rows, "k int, ran boolean, tables string")


@query("SELECT o_orderkey, 'order_' || o_custkey AS short, rpad(o_orderstatus, 12, ' ') AS label FROM orders")
def short_names(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("__order_"), "o_custkey", F.lit(".sql"))
    return orders.select("o_orderkey", short_name(name).alias("short"), padded(F.col("o_orderstatus"), 12).alias("label"))


@query("SELECT count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed FROM events")
def passed_counts(spark, d):
    return statements.passed_counts(spark.read.parquet(f"{d}/events.parquet").select((F.col("event_type") != "error").alias("passed")))


@query("SELECT user_id AS file_name FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) WHERE last = 'error'")
def resolvable(spark, d):
    """Files that may be settled: those whose latest outcome is a failure."""
    kind = F.when(F.col("event_type") == "error", "failed").otherwise("applied")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("file_name"), F.col("props").alias("checksum"), kind.alias("status"), F.col("ts").alias("applied_at"), F.col("event_id").alias("id"))
    return ledger_operators.latest(rows).where("status = 'failed'").select("file_name")
