import json
import threading
import time

import pytest

from tidequery import ConnectionFailed, Database, QueryError, StateError, TransactionError, database
from tidequery.operators.dml import Context, _hits
from tidequery.operators.results import large_digest
from tidequery.plans.frontend import script
from tidequery.sources import store


@pytest.fixture
def db(spark, tmp_path):
    with Database.open(spark, str(tmp_path / "db")) as d:
        d.execute("CREATE TABLE items(id INTEGER PRIMARY KEY, name TEXT NOT NULL, value INTEGER NOT NULL)")
        yield d


def names(db, sql="SELECT name FROM items ORDER BY id"):
    return [r["name"] for r in db.select(sql)]


def test_writes_and_results(db):
    r = db.execute("INSERT INTO items(name, value) VALUES (?, ?)", ["alice", 1])
    assert (r.affected, r.last_id) == (1, 1)
    r = db.execute("INSERT INTO items(name, value) VALUES ('bob', 1 + 1), ('carol', 1)")
    assert (r.affected, r.last_id) == (2, 3)
    rows = db.select("SELECT * FROM items WHERE value = ? ORDER BY id", [1])
    assert [dict(x) for x in rows] == [{"id": 1, "name": "alice", "value": 1}, {"id": 3, "name": "carol", "value": 1}]
    assert rows[0].get("nope") is None and list(rows[0]) == ["id", "name", "value"]
    with pytest.raises(TypeError):
        rows[0]["name"] = "x"
    assert db.execute("UPDATE items SET value = value + 10 WHERE name LIKE 'B%'").affected == 1
    assert db.execute("UPDATE items SET value = 0 WHERE id = 99").affected == 0
    assert db.execute("DELETE FROM items WHERE id = ?", [1]).affected == 1
    assert [tuple(x.values()) for x in db.select("SELECT * FROM items ORDER BY id")] == [(2, "bob", 12), (3, "carol", 1)]
    assert db.execute("DELETE FROM items").affected == 2 and db.select("SELECT * FROM items") == []


def test_types_json_and_parameters(db):
    db.execute("CREATE TABLE types(id INTEGER PRIMARY KEY, i INTEGER, r REAL, t TEXT, b BLOB, n TEXT)")
    db.execute("INSERT INTO types(i, r, t, b, n) VALUES (?, ?, ?, ?, ?)", [42, 3.5, 'q"\\\n\t日本\x01', b"\xde\xad", None])
    db.execute("INSERT INTO types(i, r, t, b) VALUES (1, 2, '7', x'')")
    row = db.select("SELECT * FROM types WHERE b = ? AND t = ?", [b"\xde\xad", 'q"\\\n\t日本\x01'])[0]
    assert tuple(row.values()) == (1, 42, 3.5, 'q"\\\n\t日本\x01', b"\xde\xad", None)
    got = json.loads(db.select_bytes("SELECT * FROM types ORDER BY id"))
    assert got == [{"id": 1, "i": 42, "r": 3.5, "t": 'q"\\\n\t日本\x01', "b": "3q0=", "n": None}, {"id": 2, "i": 1, "r": 2.0, "t": "7", "b": "", "n": None}]
    assert db.select_bytes("SELECT * FROM types WHERE id > 9") == b"[]"
    assert db.select("SELECT ? AS value", ["x"])[0]["value"] == "x"
    for sql, params in (("SELECT ?", []), ("SELECT ?", [1, 2]), ("SELEC 1", []), ("SELECT * FROM nope", []), ("DELETE FROM items", [1])):
        with pytest.raises(QueryError) as e:
            (db.execute if sql.startswith("D") else db.select)(sql, params)
        assert e.value.sql == sql
    with pytest.raises(QueryError):
        db.select("INSERT INTO items(name, value) VALUES ('x', 1)")


def test_constraints(db):
    db.execute("CREATE TABLE u(id INTEGER PRIMARY KEY, mail TEXT NOT NULL UNIQUE, done INTEGER NOT NULL DEFAULT 0 CHECK(done IN (0, 1)))")
    db.execute_batch("INSERT OR IGNORE INTO u(mail) VALUES (?)", [["a"], ["b"], ["a"]])
    assert [tuple(r.values()) for r in db.select("SELECT mail, done FROM u ORDER BY id")] == [("a", 0), ("b", 0)]
    for sql in ("INSERT INTO u(mail) VALUES ('a')", "INSERT INTO u(mail, done) VALUES ('c', 2)", "INSERT INTO u(mail) VALUES (NULL)", "UPDATE u SET mail = 'a'", "INSERT INTO u(id, mail) VALUES (1, 'z')"):
        with pytest.raises(QueryError) as e:
            db.execute(sql)
        assert e.value.code == 19
    assert db.execute("INSERT OR IGNORE INTO u(mail) VALUES ('a')").affected == 0
    r = db.execute("INSERT OR REPLACE INTO u(mail, done) VALUES ('a', 1)")
    assert (r.affected, r.last_id) == (1, 4) or r.affected == 1
    assert {(x["mail"], x["done"]) for x in db.select("SELECT * FROM u")} == {("a", 1), ("b", 0)}
    db.execute("INSERT INTO u(mail, done) VALUES ('b', 1), ('n', 0) ON CONFLICT(mail) DO UPDATE SET done = excluded.done + done")
    assert {(x["mail"], x["done"]) for x in db.select("SELECT * FROM u")} == {("a", 1), ("b", 1), ("n", 0)}


def test_batches_are_all_or_nothing(db):
    with pytest.raises(QueryError):
        db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", [["a", 1], [None, 2], ["c", 3]])
    assert names(db) == []
    with pytest.raises(ValueError):
        db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", [["a", 1], ["b"]])
    assert db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", []).affected == 0
    seq = db.store.head.seq
    assert db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", [[f"n{i}", i] for i in range(500)]).affected == 500
    assert db.store.head.seq == seq + 1
    assert db.select("SELECT COUNT(*) AS c, MAX(id) AS m, SUM(id - value) AS d FROM items")[0].values() == (500, 500, 500)
    assert db.execute_batch("UPDATE items SET value = ? WHERE id = ?", [[-1, 1], [-2, 2], [-3, 1], [0, 9999]]).affected == 2
    assert [r["value"] for r in db.select("SELECT value FROM items WHERE id < 3 ORDER BY id")] == [-3, -2]
    assert db.execute_batch("UPDATE items SET value = value + ? WHERE id = ?", [[1, 5], [1, 5]]).affected == 2
    assert db.select("SELECT value FROM items WHERE id = 5")[0]["value"] == 6
    assert db.execute_batch("DELETE FROM items WHERE id = ?", [[i] for i in range(3, 501)]).affected == 498


def test_insert_select_and_tables(db):
    db.execute("CREATE TABLE big AS SELECT id AS k, id * 2 AS v FROM range(1000)")
    r = db.execute("INSERT INTO items(name, value) SELECT 'n' || k, v FROM big WHERE k < ?", [100])
    assert (r.affected, r.last_id) == (100, 100)
    assert db.select("SELECT COUNT(DISTINCT id) AS c, MIN(id) AS a, MAX(id) AS z FROM items")[0].values() == (100, 1, 100)
    db.execute("CREATE INDEX IF NOT EXISTS ix ON items(value, name DESC); CREATE VIEW v AS SELECT name FROM items WHERE value < 4")
    assert sorted(names(db, "SELECT name FROM v")) == ["n0", "n1"]
    db.execute("ALTER TABLE items RENAME COLUMN name TO title; ALTER TABLE items ADD COLUMN extra TEXT DEFAULT 'e'; ALTER TABLE items ADD COLUMN nil REAL")
    assert db.select("SELECT * FROM items WHERE id = 1")[0] == {"id": 1, "title": "n0", "value": 0, "extra": "e", "nil": None}
    db.execute("ALTER TABLE items DROP COLUMN extra; DROP TABLE IF EXISTS nope; DROP TABLE big; PRAGMA user_version = 7; PRAGMA journal_mode = WAL")
    assert list(db.select("SELECT * FROM items LIMIT 1")[0]) == ["id", "title", "value", "nil"]
    assert db.select("PRAGMA user_version")[0]["user_version"] == 7
    with pytest.raises(QueryError):
        db.select("SELECT * FROM big")


def test_update_from(db):
    db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", [["a", 1], ["b", 2], ["c", 3]])
    db.execute("CREATE TABLE src(n TEXT, d INTEGER); INSERT INTO src VALUES ('a', 10), ('c', 30), ('c', 31)")
    assert db.execute("UPDATE items SET value = value + s.d FROM src s WHERE s.n = items.name AND s.d < ?", [100]).affected == 2
    assert [r["value"] for r in db.select("SELECT value FROM items ORDER BY id")] == [11, 2, 33]
    db.execute("WITH w AS (SELECT value AS v FROM json_each(?)) INSERT INTO items(name, value) SELECT json_extract(v, '$[0]'), CAST(json_extract(v, '$[1]') AS INTEGER) FROM w RETURNING id", ['[["x", 7]]'])
    assert db.select("SELECT name, value FROM items WHERE id IN (SELECT value FROM json_each(?))", ["[4]"])[0].values() == ("x", 7)


def test_only_touched_files_are_written_again(db):
    for k in range(3):
        db.execute("INSERT INTO items(name, value) VALUES (?, ?)", [f"n{k}", k])
    before = db.store.head.table("items").files
    db.execute("UPDATE items SET value = 9 WHERE id = 2")
    after = db.store.head.table("items").files
    assert len(set(before) & set(after)) == 2 and len(after) == 3
    assert db.diagnostics().stale_bytes > 0
    db.compact("items")
    db.vacuum()
    assert db.diagnostics().stale_bytes <= 4096 and len(names(db)) == 3


def test_transactions(db):
    def body(tx):
        tx.execute("INSERT INTO items(name, value) VALUES ('a', 1)")
        assert [r["name"] for r in tx.select("SELECT name FROM items")] == ["a"]
        assert names(db) == ["a"]  # calls on the database inside the body go to the transaction
        with pytest.raises(StateError):
            db.select_bytes("SELECT 1")

        def inner(t2):
            t2.execute("INSERT INTO items(name, value) VALUES ('b', 2)")
            raise KeyError("undo")

        with pytest.raises(KeyError):
            tx.transaction(inner)
        tx.transaction(lambda t3: t3.execute("INSERT INTO items(name, value) VALUES ('c', 3)"))
        return tx

    handle = db.transaction(body)
    assert names(db) == ["a", "c"]
    with pytest.raises(StateError):
        handle.select("SELECT 1")
    with pytest.raises(ZeroDivisionError):
        db.transaction(lambda tx: (tx.execute("DELETE FROM items"), 1 / 0))
    assert names(db) == ["a", "c"]


def test_deferred_foreign_keys(db):
    db.execute("PRAGMA foreign_keys = ON; CREATE TABLE parent(id INTEGER PRIMARY KEY); CREATE TABLE child(id INTEGER PRIMARY KEY, pid INTEGER NOT NULL, FOREIGN KEY(pid) REFERENCES parent(id) DEFERRABLE INITIALLY DEFERRED)")
    with pytest.raises(TransactionError) as e:
        db.transaction(lambda tx: tx.execute("INSERT INTO child(pid) VALUES (999)"))
    assert (e.value.operation, e.value.code) == ("commit", 19)
    db.transaction(lambda tx: (tx.execute("INSERT INTO child(pid) VALUES (1)"), tx.execute("INSERT INTO parent(id) VALUES (1)")))
    assert db.select("SELECT COUNT(*) AS c FROM child")[0]["c"] == 1


def test_writers_take_turns_and_close(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "x"))
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v INTEGER)")
    ts = [threading.Thread(target=db.execute, args=("INSERT INTO t(v) VALUES (?)", [i])) for i in range(4)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    later = db.select_later("SELECT COUNT(*) AS c, MAX(id) AS m FROM t")
    assert later.result()[0].values() == (4, 4)
    other = Database.open(spark, str(tmp_path / "x"))
    assert other.select("SELECT COUNT(*) AS c FROM t")[0]["c"] == 4
    db.execute("INSERT INTO t(v) VALUES (5)")
    with pytest.raises(TransactionError):
        other.execute("INSERT INTO t(v) VALUES (6)")
    db.close()
    db.close()
    other.close()
    for f in (lambda: db.select("SELECT 1"), lambda: db.execute("DELETE FROM t"), lambda: db.stream("SELECT 1")):
        with pytest.raises(ConnectionFailed):
            f()
    (tmp_path / "file").write_text("x")
    with pytest.raises(ConnectionFailed):
        Database.open(spark, str(tmp_path / "file" / "db"))


def test_live_queries(db):
    db.execute("CREATE TABLE other(id INTEGER PRIMARY KEY, d TEXT)")
    sql = "SELECT i.name FROM items i WHERE i.value IN (SELECT MAX(value) FROM items) ORDER BY i.id"
    a, b = db.stream(sql), db.stream(sql)
    assert a.get(60) == [] and b.get(60) == [] and len(db.streams) == 1
    db.execute("INSERT INTO items(name, value) VALUES ('x', 1)")
    assert [r["name"] for r in a.get(60)] == ["x"] == [r["name"] for r in b.get(60)]
    runs = db.streams.runs
    db.execute("INSERT INTO other(d) VALUES ('unrelated')")
    db.await_idle()
    assert db.streams.runs == runs
    db.execute("UPDATE items SET value = value")
    with pytest.raises(ZeroDivisionError):
        db.transaction(lambda tx: (tx.execute("DELETE FROM items"), 1 / 0))
    db.await_idle()
    assert db.streams.suppressed == 1 and not a.pending()
    late = db.stream(sql)
    assert [r["name"] for r in late.get(60)] == ["x"]
    db.transaction(lambda tx: [tx.execute("INSERT INTO items(name, value) VALUES (?, 5)", [n]) for n in "yz"])
    assert [r["name"] for r in a.get(60)] == ["y", "z"]
    db.execute("ALTER TABLE items RENAME COLUMN name TO gone")
    with pytest.raises(QueryError):
        a.get(60)
    db.execute("ALTER TABLE items RENAME COLUMN gone TO name")
    assert [r["name"] for r in a.get(60)] == ["y", "z"]
    for s in (a, b, late):
        s.cancel()
    assert len(db.streams) == 0
    with pytest.raises(QueryError):
        db.stream("SELECT * FROM nope").get(60)
    last = db.stream("SELECT COUNT(*) AS c FROM items")
    last.get(60)
    db.close()
    assert list(last) == []


def test_large_results_are_compared_on_the_cluster(db, monkeypatch):
    monkeypatch.setattr("tidequery.database.LARGE", 3)
    db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", [[f"n{i}", i] for i in range(9)])
    s = db.stream("SELECT value FROM items")
    assert len(s.get(60)) == 9
    db.execute("UPDATE items SET value = value")
    db.await_idle()
    assert db.streams.suppressed == 1 and not s.pending()
    db.execute("UPDATE items SET value = 100 WHERE id = 1")
    assert sum(r["value"] for r in s.get(60)) == 136


def test_bursts_end_with_the_latest_state(db):
    s = db.stream("SELECT COUNT(*) AS c FROM items")
    for i in range(6):
        db.execute("INSERT INTO items(name, value) VALUES (?, ?)", [f"n{i}", i])
    db.await_idle()
    seen, end = [], time.monotonic() + 60
    while (not seen or seen[-1] != 6) and time.monotonic() < end:
        seen.append(s.get(60)[0]["c"])
    assert seen == sorted(seen) and seen[-1] == 6 and not s.pending()


def test_digest_tells_nulls_apart(spark):
    one = lambda q: large_digest(spark.sql(q))
    assert one("select 1 a, cast(null as int) b") != one("select cast(null as int) a, 1 b")
    assert one("select 1 a union all select 1") != one("select 2 a union all select 2")


def test_a_dead_writers_lock_is_taken_over(db, spark, tmp_path, monkeypatch):
    lock = tmp_path / "db" / "_log" / f"{db.store.head.seq + 1:012d}.lock"
    lock.touch()
    with pytest.raises(TransactionError) as e:
        db.execute("INSERT INTO items(name, value) VALUES ('a', 1)")
    assert e.value.code == 5 and names(db) == []
    monkeypatch.setattr(store, "LOCK_SECONDS", -1)
    db.execute("INSERT INTO items(name, value) VALUES ('a', 1)")
    assert names(db) == ["a"]


def test_two_writers_alternate(db, spark, tmp_path):
    with Database.open(spark, str(tmp_path / "db")) as other:
        other.execute("INSERT INTO items(name, value) VALUES ('a', 1)")
        with pytest.raises(TransactionError) as e:
            db.execute("INSERT INTO items(name, value) VALUES ('b', 1)")
        assert e.value.code == 5
        assert db.execute("INSERT INTO items(name, value) VALUES ('b', 1)").last_id == 2
        with pytest.raises(TransactionError):
            other.execute("DELETE FROM items")
        assert other.execute("DELETE FROM items").affected == 2


def test_small_files_are_merged_by_themselves(db, monkeypatch):
    monkeypatch.setattr(database, "SMALL_FILES", 3)
    for k in range(5):
        db.execute("INSERT INTO items(name, value) VALUES (?, ?)", [f"n{k}", k])
    assert names(db) == [f"n{k}" for k in range(5)] and len(db.store.head.table("items").files) < 4
    assert db.vacuum() >= 3 and names(db) == [f"n{k}" for k in range(5)]


def test_upserts_one_after_the_other(db):
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, k INTEGER UNIQUE, n INTEGER)")
    db.execute("INSERT INTO t VALUES (1, 1, 1), (2, 2, 2)")
    r = db.execute_batch("INSERT INTO t VALUES (?, ?, ?) ON CONFLICT(id) DO UPDATE SET n = n * 10 + excluded.n", [[1, 8, 1], [1, 8, 2], [3, 3, 3], [3, 3, 4], [2, 2, 9]])
    assert r.affected == 5 and [tuple(x.values()) for x in db.select("SELECT * FROM t ORDER BY id")] == [(1, 1, 112), (2, 2, 29), (3, 3, 34)]
    for sql in ("INSERT INTO t VALUES (1, 0, 0) ON CONFLICT(id) DO UPDATE SET k = 2", "INSERT INTO t VALUES (9, 2, 0) ON CONFLICT(id) DO UPDATE SET n = 0"):
        with pytest.raises(QueryError) as e:
            db.execute(sql)
        assert e.value.code == 19
    assert db.execute("INSERT INTO t VALUES (1, 0, 5) ON CONFLICT(id) DO UPDATE SET n = excluded.n WHERE t.n > 1000").affected == 0


def test_commits_hold_what_changed(db, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "WHOLE", 4)
    files = lambda st: {k: (set(t.files), t.rows, t.high) for k, t in st.tables.items()}
    late = Database.open(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE other(id INTEGER PRIMARY KEY)")
    for k in range(5):
        db.execute("INSERT INTO items(name, value) VALUES (?, ?)", [f"n{k}", k])
        late.store.refresh()
        assert files(late.store.head) == files(db.store.head) and late.store.head.seq == db.store.head.seq
    db.execute("UPDATE items SET value = 9 WHERE id = 2")
    db.execute("DELETE FROM items WHERE id = 1")
    db.execute("DROP TABLE other")
    log = {p.name[:-5]: p.read_text() for p in (tmp_path / "db" / "_log").glob("*.json")}
    assert sum('"state"' in x for x in log.values()) == sum(int(k) % 4 == 1 for k in log) < len(log)
    with Database.open(spark, str(tmp_path / "db")) as again:
        assert files(again.store.head) == files(db.store.head) and names(again) == ["n1", "n2", "n3", "n4"]
    behind = Database.open(spark, str(tmp_path / "db"))
    for k in range(5):
        db.execute("INSERT INTO items(name, value) VALUES (?, ?)", [f"m{k}", k])
    db.vacuum()
    for d in (late, behind):  # their next commit's file is gone, or there
        with pytest.raises(TransactionError) as e:
            d.store.publish(d.store.head, set())
        assert e.value.code == 5 and files(d.store.head) == files(db.store.head)
        d.close()
    with Database.open(spark, str(tmp_path / "db")) as again:
        again.execute("DELETE FROM items WHERE value = 9")
        assert names(again) == ["n2", "n3", "n4", *(f"m{k}" for k in range(5))]


def test_conditions_of_writes_reach_the_scan(db, spark):
    db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", [[f"n{i}", i] for i in range(9)])
    t = db.store.head.table("items")
    cx = Context(db.store, db._session(db.store.head), db.store.head, "")
    plan = _hits(cx, t, script("id = 3 AND name IS NOT NULL")[0], {})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan


def test_names_with_spaces(db):
    db.execute('CREATE TABLE "a table%41"("the key" INTEGER PRIMARY KEY, n INTEGER)')
    db.execute('INSERT INTO "a table%41" VALUES (1, 1), (2, 2)')
    assert db.execute('UPDATE "a table%41" SET n = n + 1 WHERE "the key" = 2').affected == 1
    assert db.execute('DELETE FROM "a table%41" WHERE n = 1').affected == 1
    assert [tuple(r.values()) for r in db.select('SELECT * FROM "a table%41"')] == [(2, 3)]


def test_long_lists(db):
    db.execute_batch("INSERT INTO items(name, value) VALUES (?, ?)", [[f"n{i}", i] for i in range(50)])
    given = list(range(10, 5010))
    assert db.select(f"SELECT COUNT(*) AS c FROM items WHERE value IN ({', '.join('?' * len(given))})", given)[0]["c"] == 40


def test_whole_folders_are_read_as_folders(db, spark, monkeypatch):
    monkeypatch.setattr(store, "FOLDER", 3)
    s, t = db.store, db.store.head.table("items")
    many = s.write(t, spark.range(0, 40, 1, 4).selectExpr("id", "'x' AS name", "id AS value"))
    few = s.write(t, spark.range(0, 2, 1, 2).selectExpr("id", "'x' AS name", "id AS value"))
    s._sizes.clear()
    assert s._paths(many + few) == [many[0].rsplit("/", 1)[0], *few] and s._paths(many[1:]) == list(many[1:])
    assert s.load(t, spark, many + few).count() == 42 and s.load(t, spark, many[1:]).count() == 30
