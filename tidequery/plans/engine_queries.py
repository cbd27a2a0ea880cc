"""Queries that run the engine itself: writes, transactions and live queries over copies of the test tables, and the SQL of their final states."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidequery.database import Database
from tidequery.errors import EngineError, QueryError
from tidequery.sources.tables import TABLES, table


def fresh(spark: SparkSession) -> Database:
    """A new database under the warehouse, which all executors share."""
    return Database.open(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/tidequery_{uuid.uuid4().hex}")


def _copied(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = fresh(spark)
    for n in names:
        db.execute(f"CREATE TABLE {n} AS SELECT * FROM parquet.`{sf_dir}/{n}.parquet`")
    return db


def viewed(spark: SparkSession, sf_dir: str) -> Database:
    """A database whose views are the test tables; one for each session and directory."""
    held = spark.__dict__.setdefault("_tidequery_views", {})
    if sf_dir not in held:
        db = fresh(spark)
        db.execute("; ".join(f"CREATE VIEW {n} AS SELECT * FROM parquet.`{sf_dir}/{n}.parquet`" for n in TABLES))
        held[sf_dir] = db
    return held[sf_dir]


def _code(run: Callable[[], object], *kinds: type) -> int:
    """0, or the code of the error that run() ends with."""
    try:
        run()
    except (EngineError, *kinds) as e:
        return getattr(e, "code", 0) or -1
    return 0


def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "orders")
    db.execute("UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_orderstatus = ?", ["F"])
    db.execute("DELETE FROM orders WHERE o_orderkey % 3 = 0")
    return db.frame("SELECT o_orderkey, o_totalprice FROM orders")


def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "customer")
    n = [db.execute(s).affected for s in ("UPDATE customer SET c_acctbal = 0 WHERE c_nationkey = 3", "UPDATE customer SET c_acctbal = c_acctbal WHERE c_acctbal < -1e9", "DELETE FROM customer WHERE c_nationkey < 5")]
    return spark.createDataFrame([(k, v) for k, v in enumerate(n)], "step bigint, affected bigint")


def rowids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "nation")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT NOT NULL)")
    db.execute("INSERT INTO t(name) SELECT n_name FROM nation ORDER BY n_nationkey")
    db.execute("INSERT INTO t(id, name) VALUES (100, 'given')")
    db.execute_batch("INSERT INTO t(name) VALUES (?)", [["a"], ["b"]])
    return db.frame("SELECT id, name FROM t")


def ignore_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh(spark)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, k INTEGER UNIQUE, v TEXT NOT NULL)")
    regions = [[r.r_regionkey, r.r_name] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    db.execute_batch("INSERT INTO t(k, v) VALUES (?, ?)", regions)
    db.execute_batch("INSERT OR IGNORE INTO t(k, v) VALUES (?, ?)", [[1, "dup"], [9, "new"], [9, "again"]])
    db.execute_batch("INSERT OR REPLACE INTO t(k, v) VALUES (?, ?)", [[0, "x"], [0, "y"]])
    return db.frame("SELECT k, v FROM t")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "customer")
    db.execute("CREATE TABLE t(k INTEGER PRIMARY KEY, n INTEGER NOT NULL)")
    db.execute("INSERT INTO t SELECT c_nationkey, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
    db.execute("INSERT INTO t SELECT c_nationkey, count(*) FROM customer WHERE c_acctbal <= 0 GROUP BY c_nationkey ON CONFLICT(k) DO UPDATE SET n = n + excluded.n")
    return db.frame("SELECT k, n FROM t")


def savepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "region")

    def inner(tx) -> None:
        tx.execute("DELETE FROM region")
        raise KeyError("undone")

    def body(tx) -> None:
        tx.execute("INSERT INTO region VALUES (10, 'TEN')")
        try:
            tx.transaction(inner)
        except KeyError:
            pass
        tx.transaction(lambda t: t.execute("UPDATE region SET r_name = r_name || '!' WHERE r_regionkey < 2"))

    db.transaction(body)
    return db.frame("SELECT r_regionkey, r_name FROM region")


def batch_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh(spark)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT NOT NULL)")
    codes = []
    for rows in ([["a"], [None]], [["b"]]):
        try:
            codes.append(db.execute_batch("INSERT INTO t(name) VALUES (?)", rows).affected)
        except QueryError as e:
            codes.append(-e.code)
    return db.frame("SELECT name, ? AS first, ? AS second FROM t", codes)


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "nation")
    db.execute("PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p(id) DEFERRABLE INITIALLY DEFERRED)")

    def body(tx) -> None:
        tx.execute("INSERT INTO c(pid) SELECT n_nationkey FROM nation")
        tx.execute("INSERT INTO p SELECT n_nationkey FROM nation")

    db.transaction(body)
    code = 0
    try:
        db.execute("DELETE FROM p WHERE id = 3")
    except EngineError as e:
        code = e.code
    return db.frame("SELECT c.pid, ? AS code FROM c JOIN p ON p.id = c.pid", [code])


def json_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "nation")
    rows = json.loads(db.select_bytes("SELECT n_nationkey, n_name, nullif(n_regionkey, 1) AS r FROM nation"))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "n_nationkey bigint, n_name string, r bigint")


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live count gives: its first result, and one for each commit that changes it."""
    db = fresh(spark)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v INTEGER); CREATE TABLE other(id INTEGER PRIMARY KEY)")
    s, seen = db.stream("SELECT COUNT(*) AS n FROM t WHERE v >= 0"), []
    seen.append(s.get(120)[0]["n"])
    for values in ([[1]], [[2], [3]], [[-1]], [[4]]):
        db.execute_batch("INSERT INTO t(v) VALUES (?)", values)
        db.await_idle(120)
    db.execute("INSERT INTO other DEFAULT VALUES")
    db.execute("UPDATE t SET v = v")
    db.await_idle(120)
    while s.pending():
        seen.append(s.get(1)[0]["n"])
    db.close()
    return spark.createDataFrame([(k, n) for k, n in enumerate(seen)], "seq bigint, n bigint")


def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by row values over the orders of a customer until a page comes back empty; one row for each row of a page."""
    db = _copied(spark, sf_dir, "orders")
    at, out, page = ("9999-12-31 00:00:00", 0), [], 0
    while rows := db.select("SELECT o_orderkey, CAST(o_orderdate AS TEXT) AS d FROM orders WHERE o_custkey < 8 AND (CAST(o_orderdate AS TEXT), o_orderkey) < (?, ?) ORDER BY d DESC, o_orderkey DESC LIMIT ?", [*at, 20]):
        out += [(page, r["o_orderkey"]) for r in rows]
        at, page = (rows[-1]["d"], rows[-1]["o_orderkey"]), page + 1
    return spark.createDataFrame(out, "page bigint, o_orderkey bigint")


def ignore_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _copied(spark, sf_dir, "nation")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, k INTEGER UNIQUE)")
    db.execute("INSERT INTO t VALUES (1, 9)")
    db.execute("INSERT OR IGNORE INTO t VALUES (2, 9), (2, 5), (3, 5), (3, 6)")
    db.execute("INSERT OR IGNORE INTO t SELECT n_nationkey + 10, n_regionkey + 100 FROM nation ORDER BY n_nationkey")
    db.execute("INSERT OR REPLACE INTO t VALUES (3, 9), (4, 9), (3, 7)")
    return db.frame("SELECT id, k FROM t")


def upsert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of an upsert that would break another key, of one with a condition, and the rows that stay."""
    db = fresh(spark)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, k INTEGER UNIQUE, n INTEGER NOT NULL DEFAULT 0)")
    db.execute("INSERT INTO t VALUES (1, 9, 1), (2, 5, 2), (3, 7, 3)")
    code = _code(lambda: db.execute("INSERT INTO t(id, k) VALUES (2, 1) ON CONFLICT(id) DO UPDATE SET k = 9"))
    n = db.execute("INSERT INTO t VALUES (1, 0, 10), (2, 0, 20) ON CONFLICT(id) DO UPDATE SET n = n + excluded.n WHERE excluded.n > ?", [15]).affected
    return db.frame("SELECT id, k, n, ? AS code, ? AS affected FROM t", [code, n])


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of a thousand upserts with repeated keys."""
    db = fresh(spark)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, first INTEGER, n INTEGER NOT NULL)")
    db.execute("INSERT INTO t SELECT id, -1, 100 FROM range(0, 600, 2)")
    db.execute_batch("INSERT INTO t VALUES (?, ?, ?) ON CONFLICT(id) DO UPDATE SET n = excluded.n", [[k % 700, k, k] for k in range(1000)])
    db.execute("INSERT INTO t VALUES (1, 0, 5), (1, 0, 6), (900, 0, 1), (900, 0, 2) ON CONFLICT(id) DO UPDATE SET n = n + excluded.n")
    return db.frame("SELECT id, first, n FROM t")


def replace_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by an outside key, inserted once and replaced in batches; the replaced rows get new ids."""
    db = _copied(spark, sf_dir, "customer")
    db.execute("CREATE TABLE items(id INTEGER PRIMARY KEY, external_id INTEGER UNIQUE, payload TEXT NOT NULL)")
    db.execute("INSERT INTO items(external_id, payload) SELECT c_custkey, c_name FROM customer")
    n = db.execute_batch("INSERT OR REPLACE INTO items(external_id, payload) VALUES (?, ?)", [[k, f"new {k}"] for k in range(1, 101)]).affected
    return db.frame("SELECT external_id, payload, ? AS affected FROM items", [n])


def large_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN with 2000 parameters."""
    return viewed(spark, sf_dir).frame(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN ({', '.join('?' * 2000)})", range(0, 6000, 3))


def json_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON parameter, by a CTE and INSERT ... SELECT."""
    db = fresh(spark)
    rows = [[r.n_name, r.n_nationkey] for r in table(spark, sf_dir, "nation").collect()]
    db.execute("CREATE TABLE customers(id INTEGER PRIMARY KEY, name TEXT NOT NULL, n INTEGER)")
    db.execute("WITH w AS (SELECT value AS v FROM json_each(?)) INSERT INTO customers(name, n) SELECT v ->> 0, CAST(v ->> 1 AS INTEGER) FROM w", [json.dumps(rows)])
    return db.frame("SELECT name, n FROM customers WHERE n IN (SELECT value FROM json_each(?))", [json.dumps(list(range(20)))])


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes, a renamed and an added column, a dropped table and a view, and the code of a read of what is gone."""
    db = _copied(spark, sf_dir, "nation")
    db.execute("CREATE INDEX ix ON nation(n_regionkey, n_name DESC); CREATE TABLE gone(id INTEGER PRIMARY KEY); DROP TABLE gone")
    db.execute("ALTER TABLE nation RENAME COLUMN n_name TO title; ALTER TABLE nation ADD COLUMN extra TEXT DEFAULT 'e'; CREATE VIEW v AS SELECT title, extra FROM nation WHERE n_regionkey = 2")
    codes = [_code(lambda: db.select("SELECT * FROM gone")), _code(lambda: db.execute("CREATE UNIQUE INDEX u ON nation(nope)"))]
    db.execute("DROP INDEX ix; PRAGMA user_version = 7")
    return db.frame("SELECT title, extra, ? AS a, ? AS b, ? AS version FROM v", [int(codes[0] != 0), int(codes[1] != 0), db.select("PRAGMA user_version")[0]["user_version"]])


def transaction_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees of itself, through its handle and the database's own calls, and that its handle ends with it."""
    db, seen = _copied(spark, sf_dir, "region"), []
    count = "SELECT count(*) AS n FROM region"

    def body(tx) -> None:
        tx.execute_batch("INSERT INTO region VALUES (?, ?)", [[10, "a"], [11, "b"]])
        seen.append(tx.select(count)[0]["n"])
        db.execute("DELETE FROM region WHERE r_regionkey = ?", [10])
        seen.append(db.select(count)[0]["n"])
        seen.append(db.select_later(count).result(120)[0]["n"])
        seen.append(_code(lambda: tx.execute_batch("INSERT INTO region VALUES (?, abs(?))", [[12, 1], [13, "x"]])) and 1)
        seen.append(-_code(lambda: db.select_bytes(count)))
        held.append(tx)

    held: list = []
    db.transaction(body)
    seen += [db.select(count)[0]["n"], int(_code(lambda: held[0].select(count)) != 0)]
    return spark.createDataFrame([(k, v) for k, v in enumerate(seen)], "step bigint, n bigint")


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and files after compaction and removal of what no commit has."""
    db = _copied(spark, sf_dir, "region")
    for k in range(4):
        db.execute("INSERT INTO region VALUES (?, ?)", [100 + k, "x"])
    db.compact("region")
    gone = db.vacuum()
    d = db.diagnostics()
    return db.frame("SELECT r_regionkey, r_name, ? AS files, ? AS some_gone, ? AS stale, ? AS tables FROM region", [len(db.store.head.table("region").files), int(gone >= 5), d.stale_bytes, d.tables])


def encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read back with the key, and the codes without and with a wrong one."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/tidequery_{uuid.uuid4().hex}"
    db = Database.open(spark, folder, key="00112233445566778899aabbccddeeff")
    db.execute(f"CREATE TABLE t AS SELECT * FROM parquet.`{sf_dir}/customer.parquet`")
    db.execute("UPDATE t SET c_acctbal = 0 WHERE c_acctbal < 0")
    bad = [int(_code(lambda k=k: Database.open(spark, folder, key=k)) != 0) for k in (None, "ff" * 16)]
    again = Database.open(spark, folder, key="00112233445566778899aabbccddeeff")
    return again.frame("SELECT c_custkey, c_name, c_acctbal, ? AS without, ? AS wrong FROM t", bad)


def stream_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers of one live query and one of a view of another table: runs that were needed, events of each, an error, and what is left after cancel and close."""
    db = fresh(spark)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v INTEGER); CREATE TABLE o(id INTEGER PRIMARY KEY); CREATE VIEW w AS SELECT count(*) AS n FROM o")
    a, b, c = (db.stream(q) for q in ("SELECT sum(v) AS s FROM t", "SELECT sum(v) AS s FROM t", "SELECT n FROM w"))
    first = [x.get(120)[0] for x in (a, b, c)]
    queries = len(db.streams)

    def burst(tx) -> None:
        tx.execute("INSERT INTO t(v) VALUES (1), (2)")
        tx.execute("INSERT INTO t(v) VALUES (4)")

    db.transaction(burst)
    out = [a.get(120)[0]["s"], b.get(120)[0]["s"], queries, int(first[2]["n"]), c.pending()]
    b.cancel()
    db.execute("INSERT INTO o DEFAULT VALUES")
    out += [c.get(120)[0]["n"], b.pending(), a.pending()]
    bad = db.stream("SELECT nope FROM t")
    out.append(_code(lambda: bad.get(120)) and 1)
    db.close()
    out += [int(len(list(a)) == 0), int(_code(lambda: db.select("SELECT 1")) != 0)]
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(out)], "step bigint, n bigint")


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of awkward values: escapes, doubles and blobs."""
    db = fresh(spark)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, s TEXT, r REAL, b BLOB)")
    db.execute_batch("INSERT INTO t(s, r, b) VALUES (?, ?, ?)", [['q"\\\n\t\x01/é🎉', 3.0, b"\xde\xad"], ["", 0.1, b""], [None, 1e300, b"\xde\xad\xbe\xef!"]])
    text = db.select_bytes("SELECT s, r, b FROM t ORDER BY id").decode()
    return spark.createDataFrame([(text, len(text.encode()))], "j string, n bigint")


#: name: (query, SQL of its result)
ENGINE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "engine_update_delete": (update_delete, "select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end as o_totalprice from orders where o_orderkey % 3 <> 0"),
    "engine_affected_rows": (affected_rows, "select 0::bigint as step, count(*) as affected from customer where c_nationkey = 3 union all select 1, 0 union all select 2, count(*) from customer where c_nationkey < 5"),
    "engine_rowids": (rowids, "select row_number() over (order by n_nationkey) as id, n_name as name from nation union all values (100, 'given'), (101, 'a'), (102, 'b')"),
    "engine_ignore_replace": (ignore_replace, "select r_regionkey::bigint as k, r_name as v from region where r_regionkey <> 0 union all values (9, 'new'), (0, 'y')"),
    "engine_upsert": (upsert, "select c_nationkey::bigint as k, count(*) as n from customer group by c_nationkey"),
    "engine_savepoints": (savepoints, "select r_regionkey::bigint as r_regionkey, case when r_regionkey < 2 then r_name || '!' else r_name end as r_name from region union all values (10, 'TEN')"),
    "engine_batch_rollback": (batch_rollback, "select 'b' as name, (-19)::integer as first, 1::integer as second"),
    "engine_foreign_keys": (foreign_keys, "select n_nationkey::bigint as pid, 19::integer as code from nation"),
    "engine_json_bytes": (json_bytes, "select n_nationkey::bigint as n_nationkey, n_name, nullif(n_regionkey, 1)::bigint as r from nation"),
    "engine_stream_log": (stream_log, "select * from (values (0::bigint, 0::bigint), (1, 1), (2, 3), (3, 4)) t(seq, n)"),
    "engine_keyset_pages": (keyset_pages, "select ((row_number() over (order by o_orderdate desc, o_orderkey desc) - 1) // 20)::bigint as page, o_orderkey from orders where o_custkey < 8"),
    "engine_ignore_two_keys": (ignore_two_keys, "select * from (values (1::bigint, null::bigint), (2, 5), (4, 9), (3, 7)) t(id, k) where id <> 1 union all select min(n_nationkey) + 10, n_regionkey + 100 from nation group by n_regionkey"),
    "engine_upsert_unique": (upsert_unique, "select * from (values (1::bigint, 9::bigint, 1::bigint, 19, 1), (2, 5, 22, 19, 1), (3, 7, 3, 19, 1)) t(id, k, n, code, affected)"),
    "engine_upsert_batch": (upsert_batch, "with b as (select k % 700 as id, min(k) as f, max(k) as l from range(1000) r(k) group by 1), s as (select coalesce(b.id, t.id) as id, case when t.id is null then b.f else -1 end as first, coalesce(b.l, 100) as n from b full join (select range as id from range(0, 600, 2)) t on b.id = t.id) select id, first, n + case when id = 1 then 11 else 0 end as n from s union all values (900, 0, 3)"),
    "engine_replace_batch": (replace_batch, "select c_custkey as external_id, case when c_custkey between 1 and 100 then 'new ' || c_custkey else c_name end as payload, 100 as affected from customer"),
    "engine_large_in": (large_in, "select o_orderkey, o_totalprice from orders where o_orderkey % 3 = 0 and o_orderkey < 6000"),
    "engine_json_insert": (json_insert, "select n_name as name, n_nationkey::bigint as n from nation where n_nationkey < 20"),
    "engine_definitions": (definitions, "select n_name as title, 'e' as extra, 1 as a, 1 as b, 7 as version from nation where n_regionkey = 2"),
    "engine_transaction_reads": (transaction_reads, "select * from (values (0::bigint, 7::bigint), (1, 6), (2, 5), (3, 1), (4, 1), (5, 6), (6, 1)) t(step, n)"),
    "engine_checkpoint": (checkpoint, "select r_regionkey::bigint as r_regionkey, r_name, 1 as files, 1 as some_gone, 0 as stale, 1 as tables from region union all select 100 + k, 'x', 1, 1, 0, 1 from range(4) r(k)"),
    "engine_encryption": (encryption, "select c_custkey, c_name, greatest(c_acctbal, 0) as c_acctbal, 1 as without, 1 as wrong from customer"),
    "engine_stream_sharing": (stream_sharing, "select * from (values (0::bigint, 7::bigint), (1, 7), (2, 2), (3, 0), (4, 0), (5, 1), (6, 0), (7, 0), (8, 1), (9, 1), (10, 1)) t(step, n)"),
    "engine_json_values": (json_values, """select j, strlen(j)::bigint as n from (select '[{"s":"q\\"\\\\\\n\\t\\u0001/é🎉","r":3.0,"b":"3q0="},{"s":"","r":0.1,"b":""},{"s":null,"r":1.0E300,"b":"3q2+7yE="}]' as j)"""),
}
