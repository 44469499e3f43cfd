import pytest

from siltstone.plans.sqlfront import Connection, SqlError
from siltstone.sources.store import Conflict, Constraints, ConstraintError, NoSuchTable


MEANINGS = [
    ('SELECT 7/2', 3),
    ('SELECT 1/0', None),
    ('SELECT 5 % 0', None),
    ('SELECT 7/2.0', 3.5),
    ("SELECT '3abc' + 4", 7),
    ("SELECT CAST('12abc' AS INTEGER)", 12),
    ("SELECT 'é' LIKE 'É'", False),
    ("SELECT 'abc' LIKE 'A%'", True),
    ("SELECT substr('hello',0,2)", 'h'),
    ('SELECT typeof(1)', 'integer'),
    ('SELECT typeof(1.5)', 'real'),
    ("SELECT typeof('x')", 'text'),
    ('SELECT 9007199254740993 / 1', 9007199254740993),
    ("SELECT julianday('2000-01-01')", 2451544.5),
    ("SELECT strftime('%Y-%m', '2024-02-29')", '2024-02'),
    ("SELECT date('2024-01-31','+1 month')", '2024-03-02'),
    ("SELECT date(1700000000,'unixepoch')", '2023-11-14'),
    ('SELECT json_extract(\'{"a":[1,2]}\',\'$.a[1]\')', '2'),
    ('SELECT json_set(\'{"a":1}\',\'$.b\',2)', '{"a":1,"b":2}'),
    ('SELECT group_concat(x) FROM (VALUES (1),(2)) v(x)', '1,2'),
    ('SELECT total(x) FROM (VALUES (1),(2)) v(x)', 3.0),
    ('SELECT max(1,NULL)', None),
    ("SELECT iif(5,'a','b')", 'a'),
    ("SELECT 'a' || 1 || 2.0", 'a12.0'),
    ('SELECT 1 << 3 | 1', 9),
    ('SELECT -7 % 3', -1),
    ('SELECT NOT 3', False),
    ('SELECT count(*) FROM (SELECT 1 AS a UNION ALL SELECT 0) t WHERE a', 1),
    ("SELECT x'4142'", b'AB'),
    ("SELECT hex('ab')", '6162'),
    ("SELECT printf('%05d|%s', 7, 'x')", '00007|x'),
    ("SELECT CASE WHEN 2 THEN 'y' ELSE 'n' END", 'y'),
    ('SELECT 10 BETWEEN 1 AND 5 + 5', True),
    ('SELECT 3 IN (1,2,3) AND 1', True),
    ("SELECT 'it''s'", "it's"),
    ("SELECT instr('hello','l')", 3),
    ("SELECT 'A_b' LIKE 'a\\_B' ESCAPE '\\'", True),
    ("SELECT 'x' COLLATE NOCASE = 'X' COLLATE NOCASE", True),
    ('SELECT \'{"a":{"b":1}}\' -> \'a\'', '{"b":1}'),
    ('SELECT \'{"a":"z"}\' ->> \'a\'', 'z'),
    ('SELECT sum(a)/count(*) FROM (VALUES (3),(4)) v(a)', 3),
    ('WITH t(a) AS (SELECT 5) SELECT a/2 FROM t', 2),
    ("SELECT json_array(1,'a',NULL)", '[1,"a",null]'),
    ("SELECT json_object('k', 1)", '{"k":1}'),
    ('SELECT round(2.5)', 3.0),
    ('SELECT count(*) FILTER (WHERE a > 3) FROM (VALUES (3),(4)) v(a)', 1),
    ("SELECT group_concat(a, '-' ORDER BY a DESC) FROM (VALUES (3),(4)) v(a)", '4-3'),
    ('SELECT sum(a) OVER (ORDER BY a) AS s FROM (VALUES (3),(4)) v(a) ORDER BY 1 DESC LIMIT 1', 7),
    ('SELECT EXISTS (SELECT 1 WHERE 1=0)', False),
    ("SELECT unistr('\\0041x')", 'Ax'),
    ("SELECT json('[1, 2]')", '[1,2]'),
    ("SELECT trim('xax','x')", 'a'),
    ('SELECT nullif(1,1)', None),
    ('SELECT ~5', -6),
    ("SELECT 'abc' GLOB 'a*'", True),
    ('SELECT a.x FROM (VALUES (1)) a(x) JOIN (VALUES (1)) b(y) ON a.x == b.y', 1),
]


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    return Connection(spark, f"file://{tmp_path_factory.mktemp('db')}")


@pytest.mark.parametrize(("text", "want"), MEANINGS)
def test_meaning(db, text, want):
    got = db.query(text).take(1)[0][0]
    assert (got, type(got)) == (want, type(want))


@pytest.mark.parametrize("text", ["SELECT FROM WHERE", "SELECT (1", "SELECT 1 +", "SELECT CAST(1 AS", "SELECT substr('a')", "SELECT 'a' GLOB x FROM (VALUES ('b')) v(x)"])
def test_what_can_t_be_read(db, text):
    with pytest.raises((SqlError, Exception)):
        db.query(text).collect()


def test_types_of_columns(db, spark):
    spark.createDataFrame([(7, 2.0, "3x", True)], "i long, r double, t string, b boolean").createOrReplaceTempView("kinds")
    row = db.query("SELECT i / 2 AS a, i / r AS b, t + 1 AS c, i || r AS d, typeof(t) AS e, i % 4 AS f, (SELECT i / 2 FROM kinds) AS g FROM kinds k WHERE i AND t ORDER BY i / 2 LIMIT 0, 5").first()
    assert tuple(row) == (3, 3.5, 4.0, "72.0", "text", 3, 3)


def test_upsert_update_from_views_and_transactions(spark, tmp_path):
    db = Connection(spark, f"file://{tmp_path}")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, n INTEGER, note TEXT)")
    db.execute("INSERT INTO t VALUES (1, 10, 'a'), (2, 20, 'b')")
    db.execute("INSERT INTO t VALUES (2, 5, 'x'), (3, 30, 'c') ON CONFLICT (id) DO UPDATE SET n = t.n + excluded.n, note = excluded.note WHERE n > 10")
    rows = lambda: [tuple(r) for r in db.query("SELECT * FROM t ORDER BY id").collect()]
    assert rows() == [(1, 10, "a"), (2, 25, "x"), (3, 30, "c")]
    db.execute("INSERT INTO t VALUES (1, 0, 'z') ON CONFLICT DO NOTHING")
    db.execute("CREATE TABLE s(k INTEGER, d INTEGER)")
    db.execute("INSERT INTO s VALUES (1, 7), (3, 2)")
    db.execute("UPDATE t SET n = t.n / s.d FROM s WHERE t.id = s.k")
    assert rows() == [(1, 1, "a"), (2, 25, "x"), (3, 15, "c")]
    db.execute("CREATE VIEW v AS SELECT id, n / 2 AS h FROM t WHERE note LIKE 'A' OR n > 20")
    assert sorted(tuple(r) for r in db.query("SELECT * FROM v").collect()) == [(1, 0), (2, 12)]
    db.execute("DROP VIEW v")
    db.execute("BEGIN IMMEDIATE")
    db.execute("DELETE FROM t WHERE id = 1")
    db.execute("SAVEPOINT one")
    db.execute("DELETE FROM t")
    db.execute("ROLLBACK TO one")
    assert [r[0] for r in rows()] == [2, 3]
    db.execute("ROLLBACK")
    assert [r[0] for r in rows()] == [1, 2, 3]
    with pytest.raises(SqlError):
        db.execute("COMMIT")
    db.execute("ALTER TABLE t ADD COLUMN extra INTEGER DEFAULT 4")
    db.execute("ALTER TABLE t RENAME COLUMN note TO remark")
    db.execute("ALTER TABLE t RENAME TO u")
    assert [tuple(r) for r in db.query("SELECT id, remark, extra FROM u WHERE id = 1").collect()] == [(1, "a", 4)]
    db.execute("ALTER TABLE u DROP COLUMN extra")
    assert db.query("SELECT * FROM u").columns == ["id", "n", "remark"] and db.store.tables() == ["s", "u"]


def test_statements(spark, tmp_path):
    db = Connection(spark, f"file://{tmp_path}")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT NOT NULL, score REAL CHECK (score >= 0))")
    db.execute("INSERT INTO t VALUES (1, 'Ann', 1.5), (2, 'bob', 2)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (1, 'x', 0)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t(id, score) VALUES (3, 0)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (3, 'x', -1)")
    db.execute("INSERT OR IGNORE INTO t VALUES (1, 'x', 0), (3, 'Cy', 3)")
    db.execute("REPLACE INTO t VALUES (2, 'Bob', 9)")
    assert [r.name for r in db.execute("UPDATE t SET score = score + 1 WHERE id == 1 RETURNING name").collect()] == ["Ann"]
    assert [tuple(r) for r in db.query("SELECT * FROM t ORDER BY id").collect()] == [(1, "Ann", 2.5), (2, "Bob", 9.0), (3, "Cy", 3.0)]
    assert [r.id for r in db.query("SELECT id FROM t WHERE name GLOB '[AB]*' AND score > ?1 ORDER BY id", [3]).collect()] == [2]
    db.execute("DELETE FROM t WHERE name LIKE 'c%'")
    assert db.query_row("SELECT count(*) AS n FROM t").n == 2
    assert db.query_row("SELECT count(*) AS n FROM t FOR SYSTEM_TIME AS OF COMMITSEQ 3").n == 3
    assert [r.name for r in db.execute("PRAGMA table_info(t)").collect()] == ["id", "name", "score"]
    db.execute("CREATE TABLE u AS SELECT id * 2 AS d FROM t")
    assert sorted(r.d for r in db.query("SELECT d FROM u").collect()) == [2, 4]
    assert db.store.tables() == ["t", "u"]
    db.execute("DROP TABLE u")
    with pytest.raises(NoSuchTable):
        db.store.read("u")
    with pytest.raises(SqlError):
        db.execute("VACUUM")


def test_first_committer_wins(spark, tmp_path):
    db = Connection(spark, f"file://{tmp_path}")
    db.execute("CREATE TABLE t(a INTEGER)")
    db.store.commit("t", db.store.read("t"), Constraints(), 1, "x")
    with pytest.raises(Conflict):
        db.store.commit("t", db.store.read("t"), Constraints(), 1, "y")


def test_savepoints(spark, tmp_path):
    db = Connection(spark, f"file://{tmp_path}")
    db.execute("CREATE TABLE t(a INTEGER)")
    tx = db.store.transaction()
    db.execute("INSERT INTO t VALUES (1)")
    tx.savepoint("s")
    db.execute("INSERT INTO t VALUES (2)")
    tx.rollback("s")
    assert [r.a for r in db.query("SELECT a FROM t").collect()] == [1]
    tx.rollback()
    assert db.query("SELECT a FROM t").count() == 0
