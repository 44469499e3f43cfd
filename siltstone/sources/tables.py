"""Reading tables: Parquet folders, SQLite files, text dumps; and writing them."""

from __future__ import annotations

import atexit
import shutil
import sqlite3
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views, under their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; only a local master may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_sqlite(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(16) == b"SQLite format 3\x00"


def load_sqlite(spark: SparkSession, path: str, name: str, out: str) -> DataFrame:
    """A table of a SQLite file, through the driver in blocks of ROWS, as Parquet in the folder out."""
    if not is_sqlite(path):
        raise ValueError(f"{path} is no SQLite file")
    kinds = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary", "NUMERIC": "double"}
    from siltstone.functions.dialect import affinity

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cols = [(r[1], kinds[affinity(r[2])]) for r in db.execute(f'PRAGMA table_info("{name}")')]
        if not cols:
            raise LookupError(f"no such table: {name}")
        schema = ", ".join(f"`{c}` {k}" for c, k in cols)
        found = db.execute(f'SELECT * FROM "{name}"')
        first = True
        while first or rows:
            rows = found.fetchmany(ROWS)
            if rows or first:
                typed = [tuple(_as(v, k) for v, (_, k) in zip(r, cols, strict=True)) for r in rows]
                spark.createDataFrame(typed, schema).write.mode("overwrite" if first else "append").parquet(out)
            first = False
    return spark.read.parquet(out)


def _as(v, kind: str):
    if v is None:
        return None
    return {"bigint": int, "double": float, "string": str, "binary": lambda x: x if isinstance(x, bytes) else str(x).encode()}[kind](v)


def save_sqlite(df: DataFrame, path: str, name: str) -> int:
    """Writes df to a SQLite file, row by row from an iterator; for results of a size that such a file is for."""
    names = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    n = 0
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE "{name}" (' + ", ".join(f'"{c}" {names.get(k, "TEXT")}' for c, k in df.dtypes) + ")")
        for row in df.toLocalIterator():
            db.execute(f'INSERT INTO "{name}" VALUES ({",".join("?" * len(row))})', [v if isinstance(v, int | float | bytes | str | None) else str(v) for v in row])
            n += 1
    return n


def dump(df: DataFrame, name: str, path: str) -> None:
    """CREATE TABLE and INSERT statements as text files, a part per task."""
    from pyspark.sql import functions as F

    from siltstone.functions.dialect import quote

    cells = [quote(F.col(c).cast("string"), "number" if k in ("bigint", "int", "double", "float") else "text") for c, k in df.dtypes]
    df.select(F.concat(F.lit(f'INSERT INTO "{name}" VALUES ('), F.concat_ws(",", *cells), F.lit(");"))).write.mode("overwrite").text(path)
    Path(path.removeprefix("file://"), "_schema.sql").write_text(f'CREATE TABLE "{name}" ({", ".join(f"{c} {k}" for c, k in df.dtypes)});\n')


def compact(df: DataFrame, path: str, partitions: int) -> None:
    """VACUUM INTO: the same rows in fewer files."""
    df.coalesce(partitions).write.mode("overwrite").parquet(path)
