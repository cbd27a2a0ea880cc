import time

import pytest

from tidequery import ConnectionFailed, Database

KEY = "00112233445566778899aabbccddeeff"


def test_encryption(spark, tmp_path):
    d = str(tmp_path / "e")
    with Database.open(spark, d, key=KEY) as db:
        db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT, value REAL, b BLOB)")
        db.execute_batch("INSERT INTO t(name, value, b) VALUES (?, ?, ?)", [["alice-secret", 1.5, b"\x00\xff"], [None, 2.5, b""]])
        db.execute("UPDATE t SET value = value + 1 WHERE name = 'alice-secret'")
    raw = b"".join(f.read_bytes() for f in (tmp_path / "e").rglob("*.parquet"))
    assert raw and b"alice-secret" not in raw
    with Database.open(spark, d, key=KEY) as db:
        assert [tuple(r.values()) for r in db.select("SELECT * FROM t ORDER BY id")] == [(1, "alice-secret", 2.5, b"\x00\xff"), (2, None, 2.5, b"")]
    for key in (None, "ff" * 16, "zz", "0" * 10):
        with pytest.raises(ConnectionFailed):
            Database.open(spark, d, key=key)
    with Database.open(spark, str(tmp_path / "p")) as db:
        db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY)")
    with pytest.raises(ConnectionFailed):
        Database.open(spark, str(tmp_path / "p"), key=KEY)


def test_following_another_writer(spark, tmp_path):
    a = Database.open(spark, str(tmp_path / "s"))
    a.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v INTEGER)")
    b = Database.open(spark, str(tmp_path / "s"))
    s = b.stream("SELECT COUNT(*) AS c FROM t")
    assert s.get(60)[0]["c"] == 0
    q = b.follow()
    try:
        a.execute("INSERT INTO t(v) VALUES (1)")
        assert s.get(90)[0]["c"] == 1
        end = time.monotonic() + 30
        while b.store.head.seq < a.store.head.seq and time.monotonic() < end:
            time.sleep(0.1)
        assert b.execute("INSERT INTO t(v) VALUES (2)").last_id == 2
    finally:
        q.stop()
        a.close()
        b.close()
