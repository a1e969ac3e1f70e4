"""One query for each operator over the supplied tables, and the same in SQL for DuckDB.

Stand-ins: ledger = events (file: user_id; purchase, click and view are applied, error is failed, signup is skipped;
checksum: props). Graph = orders, each depending on its customer's previous and first order. Statements = events of a
user in time (signup begins a transaction, purchase commits it, click makes an index, error is any DDL, view creates).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import script_queries, source_queries
from ledgerloom.functions import sqltext
from ledgerloom.functions.naming import Naming, next_serial
from ledgerloom.operators import graph, ledger, manifest, snapshot, statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# the ledger


def ledger_rows(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("applied")
    return read(spark, folder, "events").select(F.col("user_id").alias("file_name"), F.col("props").alias("checksum"), kind.alias("status"), F.col("ts").alias("applied_at"), F.col("event_id").alias("id"))


def ledger_files(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as files; the current checksum of one with a history is that of its row 1 + key % 3 from the last."""
    order = Window.partitionBy("file_name").orderBy(F.desc("applied_at"), F.desc("id"))
    rows = ledger_rows(spark, folder).withColumn("rn", F.row_number().over(order)).where(F.col("rn") == 1 + F.col("file_name") % 3)
    names = read(spark, folder, "customer").select(F.col("c_custkey").alias("file_name"))
    return names.join(rows.select("file_name", "checksum"), "file_name", "left").withColumn("editable", F.col("file_name") % 2 == 0)


_LEDGER = """
    ledger AS (SELECT user_id AS file_name, props AS checksum, ts AS applied_at, event_id AS id,
                      CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'applied' END AS status,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    files AS (SELECT c_custkey AS file_name, l.checksum, c_custkey % 2 = 0 AS editable
              FROM customer LEFT JOIN ledger l ON l.file_name = c_custkey AND l.rn = 1 + c_custkey % 3),
    past AS (SELECT DISTINCT file_name, checksum FROM ledger WHERE rn > 1)"""
_STATUS = f"""{_LEDGER},
    statuses AS (SELECT f.file_name, f.checksum, l.applied_at,
        CASE WHEN l.status IS NULL THEN 'pending' WHEN l.status IN ('failed', 'skipped') THEN l.status
             WHEN f.checksum IS DISTINCT FROM l.checksum THEN 'changed' ELSE 'applied' END AS status
        FROM files f LEFT JOIN ledger l ON l.file_name = f.file_name AND l.rn = 1)"""


@query(f"WITH {_LEDGER} SELECT file_name, applied_at, id, checksum, status FROM ledger WHERE rn = 1")
def ledger_latest(spark, d):
    return ledger.latest(ledger_rows(spark, d))


@query(f"WITH {_LEDGER} SELECT file_name, checksum FROM past")
def ledger_past_checksums(spark, d):
    return ledger.past_checksums(ledger_rows(spark, d))


@query(f"WITH {_STATUS} SELECT file_name, status, checksum, applied_at FROM statuses")
def ledger_status(spark, d):
    return ledger.status(ledger_files(spark, d), ledger_rows(spark, d))


@query(f"""WITH {_STATUS} SELECT count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'pending') AS pending,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'changed') AS changed, count(*) AS total FROM statuses""")
def status_counts(spark, d):
    return ledger.status_counts(ledger_status(spark, d))


@query(f"""WITH {_LEDGER} SELECT f.file_name, CASE WHEN l.status IS NULL THEN 'execute' WHEN l.status = 'skipped' THEN 'skip'
    WHEN l.status = 'failed' AND editable THEN 'retry' WHEN l.status = 'failed' THEN 'unresolved-failure'
    WHEN f.checksum IS NOT DISTINCT FROM l.checksum THEN 'unchanged' WHEN p.file_name IS NOT NULL THEN 'ancestor-revert'
    WHEN editable THEN 're-apply' ELSE 'tampering' END AS action
    FROM files f LEFT JOIN ledger l ON l.file_name = f.file_name AND l.rn = 1 LEFT JOIN past p ON p.file_name = f.file_name AND p.checksum = f.checksum""")
def apply_decision(spark, d):
    return ledger.decisions(ledger_files(spark, d), ledger_rows(spark, d))


@query(f"WITH {_LEDGER} SELECT f.file_name, f.checksum FROM files f JOIN past p ON p.file_name = f.file_name AND p.checksum = f.checksum")
def regression_hits(spark, d):
    return ledger.regressions(ledger_files(spark, d).select("file_name", "checksum"), ledger_rows(spark, d))


@query("SELECT c_custkey AS file_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def pending_files(spark, d):
    return ledger.pending(ledger_files(spark, d).select("file_name"), ledger_rows(spark, d))


@query("SELECT user_id AS file_name, count(*) AS n_records, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
def ledger_history(spark, d):
    rows = ledger.history(ledger_rows(spark, d))
    return rows.select("file_name", F.size("records").cast("long").alias("n_records"), F.array_join(F.transform("records", lambda r: r["id"].cast("string")), ",").alias("ids"))


# the manifest: documents as files, labels as what is recorded


def files(spark: SparkSession, folder: str) -> DataFrame:
    cols = (F.col("doc_id").alias("file_name"), F.col("n_chars").cast("string").alias("checksum"), F.col("doc_id").alias("sort_key"), F.lit(0).alias("dir_index"), "source")
    return read(spark, folder, "documents").select(*cols)


def recorded_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as a manifest; recorded checksums differ for every third document and are empty for every seventh. Besides, files that are gone."""
    key = F.col("doc_id")
    known = read(spark, folder, "labels").join(read(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    known = known.select(key.alias("file"), F.when(key % 7 == 0, "").when(key % 3 == 0, F.concat(F.lit("old-"), "n_chars")).otherwise(F.col("n_chars").cast("string")).alias("checksum"))
    gone = read(spark, folder, "labels").select((-1 - key).alias("file"), F.lit("gone").alias("checksum")).where(F.col("file") % 10 == 0)
    return known.unionByName(gone)


_MANIFEST = """
    files AS (SELECT doc_id AS file_name, CAST(n_chars AS VARCHAR) AS checksum, doc_id AS sort_key, source FROM documents),
    manifest AS (SELECT doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'old-' || n_chars ELSE CAST(n_chars AS VARCHAR) END AS checksum
                 FROM labels JOIN documents USING (doc_id)
                 UNION ALL SELECT -1 - doc_id, 'gone' FROM labels WHERE (-1 - doc_id) % 10 = 0)"""


@query(f"WITH {_MANIFEST} SELECT file_name FROM files WHERE file_name IN (SELECT file FROM manifest)")
def recorded_files(spark, d):
    return manifest.recorded(files(spark, d), recorded_rows(spark, d)).select("file_name")


@query(f"WITH {_MANIFEST} SELECT file_name FROM files WHERE file_name NOT IN (SELECT file FROM manifest)")
def new_files(spark, d):
    return manifest.new_files(files(spark, d), recorded_rows(spark, d)).select("file_name")


@query(f"WITH {_MANIFEST} SELECT file, checksum FROM manifest WHERE file NOT IN (SELECT file_name FROM files)")
def missing_files(spark, d):
    return manifest.missing(files(spark, d), recorded_rows(spark, d))


@query(f"""WITH {_MANIFEST} SELECT file_name, substr(m.checksum, 1, 12) AS expected, substr(f.checksum, 1, 12) AS actual FROM files f JOIN manifest m ON m.file = f.file_name
    WHERE m.checksum <> f.checksum AND m.checksum <> '' AND file_name <> (SELECT max(file_name) FROM files)""")
def checksum_mismatch(spark, d):
    return manifest.mismatches(files(spark, d), recorded_rows(spark, d), manifest.tail(files(spark, d)))


@query(f"""WITH {_MANIFEST}, last AS (SELECT max(sort_key) AS last_key FROM files WHERE file_name IN (SELECT file FROM manifest))
    SELECT file_name, sort_key, last_key FROM files, last WHERE file_name NOT IN (SELECT file FROM manifest) AND sort_key < last_key""")
def mid_sequence_insert(spark, d):
    return manifest.mid_sequence(files(spark, d), recorded_rows(spark, d))


@query(f"WITH {_MANIFEST} SELECT file_name, count(*) OVER () AS new_count FROM files WHERE file_name NOT IN (SELECT file FROM manifest)")
def several_new_files(spark, d):
    return manifest.several_new(files(spark, d), recorded_rows(spark, d))


@query("SELECT max(doc_id) AS file_name FROM documents")
def tail_file(spark, d):
    return manifest.tail(files(spark, d))


@query("SELECT source, max(doc_id) AS file_name FROM documents GROUP BY source")
def tail_per_dir(spark, d):
    return manifest.tail(files(spark, d), "source")


@query(f"""WITH {_MANIFEST}, tails AS (SELECT max(file_name) AS file_name, source FROM files GROUP BY source),
    named AS (SELECT file_name, 0 AS p, 'latest' AS reason FROM tails UNION ALL SELECT file_name, 1, 'new' FROM files WHERE file_name NOT IN (SELECT file FROM manifest)
              UNION ALL SELECT user_id, 2, 'failed-retryable' FROM (SELECT user_id, arg_max(event_type, ts) AS last FROM events GROUP BY user_id) WHERE last = 'error')
    SELECT file_name, arg_min(reason, p) AS reason FROM named GROUP BY file_name""")
def editable_union(spark, d):
    f, m = files(spark, d), recorded_rows(spark, d)
    failed = ledger.latest(ledger_rows(spark, d)).where("status = 'failed'").select("file_name")
    return manifest.first_reason((manifest.tail(f, "source"), "latest"), (manifest.new_files(f, m), "new"), (failed, "failed-retryable"))


# text


#: Quoted text, or a run of white space and comments, or other text. Comments inside comments and named dollar quotes are
#: beyond this pattern; the supplied texts have none, and tests hold the lexer against cases of both.
_TOKENS = (
    r"""[eE]'(?:[^'\\]|\\(?s:.)|'')*(?:'|\\?\z)|'(?:[^']|'')*(?:'|\z)|"(?:[^"]|"")*(?:"|\z)|\$\$(?s:.*?)(?:\$\$|\z)|(?:\s|--[^\n]*|/\*(?s:.*?)(?:\*/|\z))+|[^\s'"$/eE-]+|(?s:.)"""
)
_NORMALIZED = f"""SELECT doc_id, sha256(trim(array_to_string(list_transform(regexp_extract_all(text, '{_TOKENS.replace("'", "''")}'),
    lambda t: CASE WHEN regexp_matches(t, '^(\\s|--|/[*])') THEN ' ' ELSE t END), ''))) AS checksum FROM documents"""


@query(_NORMALIZED)
def text_checksum(spark, d):
    return read(spark, d, "documents").select("doc_id", sqltext.checksum(F.col("text")).alias("checksum"))


@query(f"WITH c AS ({_NORMALIZED}) SELECT checksum, count(*) AS n_files, min(doc_id) AS first_file FROM c WHERE checksum IS NOT NULL GROUP BY checksum HAVING count(*) > 1")
def duplicate_checksums(spark, d):
    return text_checksum(spark, d).where("checksum is not null").groupBy("checksum").agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_file")).where("n_files > 1")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '__order_' || o_custkey || '.sql' AS file_name FROM orders""")
def filename_generate(spark, d):
    n = Naming()
    return read(spark, d, "orders").select("o_orderkey", n.name(n.stamp(F.col("o_orderdate")), F.concat(F.lit("order_"), "o_custkey")).alias("file_name"))


@query("""WITH f AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '__order_' || o_custkey || '.sql' AS file_name FROM orders)
    SELECT o_orderkey, regexp_extract(file_name, '^(\\d{8}_\\d{6})__(.+)[.]sql$', 1) AS sort_key, regexp_extract(file_name, '^(\\d{8}_\\d{6})__(.+)[.]sql$', 2) AS description FROM f""")
def filename_parse(spark, d):
    parsed = Naming().parsed(F.col("file_name"))
    return filename_generate(spark, d).withColumn("parsed", parsed).where("parsed is not null").select("o_orderkey", "parsed.sort_key", "parsed.description")


@query("SELECT c_mktsegment, lpad(CAST(max(c_custkey) + 1 AS VARCHAR), CAST(greatest(6, length(CAST(max(c_custkey) + 1 AS VARCHAR))) AS INTEGER), '0') AS next_serial FROM customer GROUP BY c_mktsegment")
def next_serial_per_segment(spark, d):
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(next_serial(F.col("c_custkey").cast("string"), 6).alias("next_serial"))


_DIRECTIVES = "'-- loom:allow rule-' || (doc_id % 5) || ', rule-' || (doc_id % 3) || chr(10) || '-- loom:depends-on ' || source || '.sql' || chr(10) || text"


@query(f"""WITH t AS (SELECT doc_id, {_DIRECTIVES} AS sql FROM documents)
    SELECT DISTINCT doc_id, unnest(['rule-' || (doc_id % 5), 'rule-' || (doc_id % 3)]) AS name, 'allow' AS kind FROM t
    UNION ALL SELECT doc_id, regexp_extract(sql, '-- loom:depends-on (\\S+)', 1), 'depends-on' FROM t""")
def directive_extract(spark, d):
    texts = read(spark, d, "documents").select("doc_id", F.expr(_DIRECTIVES.replace("chr(10)", "'\\n'")).alias("sql"))
    one = lambda names, kind: texts.select("doc_id", F.explode(names).alias("name"), F.lit(kind).alias("kind"))
    return one(sqltext.allowed_rules(F.col("sql")), "allow").union(one(sqltext.declared_dependencies(F.col("sql")), "depends-on"))


# the graph of orders


def order_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, via, priority, ord): each order to its customer's previous one, then to the first one."""
    mine = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, folder, "orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(mine).alias("previous"), F.first("o_orderkey").over(mine.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    edge = lambda to, via, p: rows.where(F.col(to).isNotNull() & (F.col(to) != F.col("src"))).select("src", F.col(to).alias("dst"), F.lit(via).alias("via"), F.lit(p).alias("priority"), F.lit(0).alias("ord"))
    return edge("previous", "previous", 0).union(edge("first", "first", 1))


def order_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("node"))


_EDGES = """
    placed AS (SELECT o_orderkey, o_custkey, o_orderstatus, lag(o_orderkey) OVER w AS previous, first_value(o_orderkey) OVER w AS first,
                      row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS n_all FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    edges AS (SELECT o_orderkey AS src, previous AS dst, 'previous' AS via, 0 AS p FROM placed WHERE previous IS NOT NULL
              UNION ALL SELECT o_orderkey, first, 'first', 1 FROM placed WHERE first <> o_orderkey)"""


@query("""SELECT l_partkey AS name, arg_max(l_suppkey, (l_orderkey, l_linenumber)) AS creator FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1 GROUP BY l_partkey""")
def creators_last_wins(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file_name"), F.col("l_orderkey").alias("file_ord"), F.struct("l_linenumber", "l_suppkey").alias("create_ord"))
    return graph.last_creators(rows)


@query(f"WITH {_EDGES} SELECT src, dst, arg_min(via, p) AS via FROM edges GROUP BY src, dst")
def edges_dedup(spark, d):
    return graph.first_edges(order_edges(spark, d), "via")


@query(f"WITH {_EDGES} SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT dst FROM edges)")
def leaves(spark, d):
    return graph.leaves(order_nodes(spark, d), order_edges(spark, d))


@query(f"WITH {_EDGES} SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT src FROM edges)")
def roots(spark, d):
    return graph.roots(order_nodes(spark, d), order_edges(spark, d))


@query(f"WITH {_EDGES} SELECT o_orderkey AS node, n_all - n AS dependents FROM placed WHERE n_all > n")
def transitive_dependents(spark, d):
    found = graph.closure(order_edges(spark, d))
    return found.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))


@query(f"WITH {_EDGES} SELECT o_orderkey AS node, n - 1 AS depth FROM placed")
def depth(spark, d):
    return graph.depths(order_nodes(spark, d), order_edges(spark, d))


@query(f"WITH {_EDGES} SELECT o_orderkey AS child, previous AS parent FROM placed WHERE previous IS NOT NULL")
def primary_parent(spark, d):
    return graph.primary_parents(order_edges(spark, d), depth(spark, d))


@query(f"WITH {_EDGES} SELECT o_orderkey AS node FROM placed WHERE o_custkey % 10 = 0 AND n_all > 1")
def cycle_nodes(spark, d):
    last = read(spark, d, "orders").where("o_custkey % 10 = 0").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("a"), F.max(F.struct("o_orderdate", "o_orderkey")).alias("b"))
    back = last.select(F.col("a.o_orderkey").alias("src"), F.col("b.o_orderkey").alias("dst")).where("src <> dst")
    return graph.cycle_nodes(order_edges(spark, d).select("src", "dst").union(back))


@query(f"WITH {_EDGES} SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM placed")
def components(spark, d):
    found = graph.components(order_edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return order_nodes(spark, d).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query(f"WITH {_EDGES} SELECT n - 1 AS level, count(*) AS n_nodes, min(o_orderkey) AS first_node FROM placed GROUP BY n")
def topo_levels(spark, d):
    return depth(spark, d).groupBy(F.col("depth").alias("level")).agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


@query(f"""WITH {_EDGES}, failed AS (SELECT o_custkey, min(n) AS n FROM placed WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT o_orderkey AS node FROM placed p JOIN failed f USING (o_custkey) WHERE p.n > f.n AND o_orderstatus <> 'F'""")
def blocked_by_failure(spark, d):
    failed = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"))
    return graph.blocked(order_edges(spark, d), failed)


@query(f"""WITH {_EDGES}, c AS (SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, * FROM (SELECT * FROM orders))
    SELECT component, string_agg(CAST(o_orderkey AS VARCHAR), '_and_' ORDER BY o_orderdate, o_orderkey) AS description,
           string_agg('-- Source: ' || o_orderkey || chr(10) || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderdate, o_orderkey) AS sql, count(*) AS n_files
    FROM c GROUP BY component HAVING count(*) >= 2""")
def squash_groups(spark, d):
    order = read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("sort_key"), F.col("o_orderkey").alias("file_name"), F.col("o_orderkey").cast("string").alias("description"), F.col("o_orderpriority").alias("sql"))
    return manifest.squashed(components(spark, d).join(order, "node"))


# statements and rules


def statement_rows(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, folder, "events").select(F.col("user_id").alias("file_name"), F.row_number().over(order).cast("long").alias("ord"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("name"))


_STATEMENTS = """
    statements AS (SELECT user_id AS file_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS kind, CAST(floor(value) AS BIGINT) AS name FROM events)"""
_SO_FAR = "PARTITION BY file_name ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def kind(name: str):
    return F.col("kind") == name


@query(f"""WITH {_STATEMENTS}, f AS (SELECT *, kind = 'view' AND name IS NOT NULL AND row_number() OVER (PARTITION BY file_name, kind, name ORDER BY ord) = 1 AS new FROM statements)
    SELECT file_name, ord, count(*) FILTER (new) OVER ({_SO_FAR}) AS created FROM f""")
def ctx_created_so_far(spark, d):
    return statements.created_count(statement_rows(spark, d), kind("view") & F.col("name").isNotNull(), "name").select("file_name", "ord", "created")


@query(f"WITH {_STATEMENTS} SELECT file_name, ord, bool_or(kind = 'signup') OVER ({_SO_FAR}) AS latched FROM statements")
def ctx_latch(spark, d):
    return statement_rows(spark, d).select("file_name", "ord", statements.latch(kind("signup")).alias("latched"))


_IN_TRANSACTION = f"""{_STATEMENTS},
    marked AS (SELECT *, CASE kind WHEN 'signup' THEN true WHEN 'purchase' THEN false END AS turn FROM statements),
    inside AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER ({_SO_FAR}), false) AS in_transaction FROM marked)"""


@query(f"WITH {_IN_TRANSACTION} SELECT file_name, ord, in_transaction FROM inside")
def ctx_in_transaction(spark, d):
    return statement_rows(spark, d).select("file_name", "ord", statements.toggle(kind("signup"), kind("purchase")).alias("in_transaction"))


@query(f"WITH {_IN_TRANSACTION} SELECT file_name, ord FROM inside WHERE in_transaction AND kind = 'click'")
def lint_in_transaction(spark, d):
    rows = statement_rows(spark, d).withColumn("inside", statements.toggle(kind("signup"), kind("purchase")))
    return rows.where(F.col("inside") & kind("click")).select("file_name", "ord")


@query(f"WITH {_STATEMENTS}, l AS (SELECT *, bool_or(kind = 'signup') OVER ({_SO_FAR}) AS ok FROM statements) SELECT file_name, min(ord) AS ord FROM l WHERE kind = 'error' AND NOT ok GROUP BY file_name")
def lint_first_only(spark, d):
    rows = statement_rows(spark, d).withColumn("ok", statements.latch(kind("signup")))
    return statements.first_hit(rows, kind("error") & ~F.col("ok")).select("file_name", "ord")


@query(f"""WITH {_STATEMENTS} SELECT file_name, name, max(ord) FILTER (kind = 'click') AS started FROM statements GROUP BY file_name, name
    HAVING max(ord) FILTER (kind = 'click') IS NOT NULL AND coalesce(max(ord) FILTER (kind = 'purchase'), 0) < max(ord) FILTER (kind = 'click')""")
def lint_needs_followup(spark, d):
    return statements.needs_follow_up(statement_rows(spark, d), kind("click"), kind("purchase"), "name").select("file_name", "name", "started")


@query(f"WITH {_STATEMENTS} SELECT file_name || '/' || name AS file_name FROM statements WHERE name IS NOT NULL GROUP BY file_name, name HAVING bool_or(kind = 'signup') AND NOT bool_or(kind = 'error')")
def lint_set_without_reset(spark, d):
    rows = statement_rows(spark, d).where("name is not null").withColumn("file_name", F.concat_ws("/", "file_name", "name"))
    return statements.set_without(rows, kind("signup"), kind("error"))


@query(f"""WITH {_STATEMENTS} SELECT file_name, ord FROM statements s WHERE kind = 'purchase' AND EXISTS
    (SELECT 1 FROM statements p WHERE p.file_name = s.file_name AND p.name IS NOT DISTINCT FROM s.name AND p.kind = 'click' AND p.ord < s.ord)""")
def lint_seen_before(spark, d):
    rows = statement_rows(spark, d).withColumn("seen", statements.seen_before(kind("click"), "name"))
    return rows.where(F.col("seen") & kind("purchase")).select("file_name", "ord")


_VIOLATIONS = f"""{_STATEMENTS},
    allowed AS (SELECT DISTINCT user_id AS file_name, event_type AS rule FROM events WHERE event_id % 40 = 0),
    violations AS (SELECT file_name, ord, kind AS rule FROM statements s WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.file_name = s.file_name AND a.rule = s.kind))"""


def violation_rows(spark: SparkSession, folder: str) -> DataFrame:
    allowed = read(spark, folder, "events").where("event_id % 40 = 0").select(F.col("user_id").alias("file_name"), F.col("event_type").alias("rule")).distinct()
    return statements.not_allowed(statement_rows(spark, folder).select("file_name", "ord", F.col("kind").alias("rule")), allowed)


@query(f"WITH {_VIOLATIONS} SELECT file_name, rule, ord FROM violations")
def lint_allowlist_antijoin(spark, d):
    return violation_rows(spark, d)


@query(f"""WITH {_VIOLATIONS} SELECT file_name, count(*) FILTER (rule NOT IN ('click', 'view')) AS errors, count(*) FILTER (rule = 'click') AS warnings
    FROM violations WHERE rule <> 'view' GROUP BY file_name""")
def lint_severity_counts(spark, d):
    severity = spark.createDataFrame([("click", "warn"), ("view", "off"), ("error", "error")], "rule string, severity string")
    return statements.severity_counts(statements.with_severity(violation_rows(spark, d), severity), "file_name")


# snapshots and nested values


_DUMP = "concat('-- dump', chr(10), 'SET x = 1;', chr(10), chr(10), replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), chr(10), chr(10))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_DUMP}, chr(10))) AS line, generate_subscripts(string_split({_DUMP}, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, pos, rtrim(line) AS line FROM l WHERE NOT regexp_matches(rtrim(line), '^(--|SET |SELECT pg_catalog[.]|COMMENT ON EXTENSION|[\\\\](un)?restrict)')),
    w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before, min(pos) FILTER (line <> '') OVER (PARTITION BY doc_id) AS lo, max(pos) FILTER (line <> '') OVER (PARTITION BY doc_id) AS hi FROM k)
    SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY pos) || chr(10)) AS digest FROM w WHERE pos BETWEEN lo AND hi AND (line <> '' OR before <> '') GROUP BY doc_id""")
def schema_normalize(spark, d):
    texts = read(spark, d, "documents").select("doc_id", F.expr(_DUMP.replace("chr(10)", "'\\n'")).alias("text"))
    return snapshot.normalized_text(snapshot.lines(texts, "doc_id", "text"), "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    a AS (SELECT * FROM l), b AS (SELECT doc_id - 1 AS doc_id, line, pos FROM l)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) AS n_different, CAST(min(coalesce(a.pos, b.pos)) AS BIGINT) AS first_pos
    FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos WHERE a.line IS DISTINCT FROM b.line GROUP BY 1""")
def positional_diff(spark, d):
    """Each document against the next one."""
    rows = snapshot.lines(read(spark, d, "documents"), "doc_id", "text")
    found = snapshot.differences(rows, rows.withColumn("doc_id", F.col("doc_id") - 1), "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_different"), F.min("pos").cast("long").alias("first_pos"))


@query("""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS has_large, len(list_filter(embedding, lambda x: abs(x) > 1)) = 0 AS all_small,
    CAST(len(list_filter(embedding, lambda x: x < 0)) AS BIGINT) AS n_negative FROM embeddings""")
def explode_nested_refs(spark, d):
    e = "embedding"
    return read(spark, d, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.exists(e, lambda x: x > 0.2).alias("has_large"), F.forall(e, lambda x: F.abs(x) <= 1).alias("all_small"), F.size(F.filter(e, lambda x: x < 0)).cast("long").alias("n_negative"))


for _more in (script_queries, source_queries):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL
