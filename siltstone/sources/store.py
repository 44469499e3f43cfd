"""Versioned tables: each commit writes a new Parquet folder and one line of a log; readers see whole versions.

A statement computes the next version as a DataFrame over the current one (copy on write) and checks constraints as
joins before the log line is written; a writer whose base is no longer the last version has to start again. Older versions
stay readable by number or time."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A UNIQUE, NOT NULL, CHECK or FOREIGN KEY constraint that does not hold."""


class Conflict(RuntimeError):
    """Another commit came first."""


class NoSuchTable(LookupError):
    """No table, or no version of it, by that name."""


@dataclass
class Constraints:
    key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    check: list[str] = field(default_factory=list)
    generated: dict[str, str] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.changes = self.total_changes = 0
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = jvm.org.apache.hadoop.fs.Path

    # --- log ---

    def log(self, name: str) -> list[dict]:
        folder = self._at(f"{self.path}/{name}/_log")
        if not self._fs.exists(folder):
            return []
        names = sorted(str(s.getPath().getName()) for s in self._fs.listStatus(folder))
        lines = self.spark.read.text(f"{self.path}/{name}/_log").collect() if names else []
        return sorted((json.loads(r.value) for r in lines), key=lambda x: x["seq"])

    def commit(self, name: str, df: DataFrame, rules: Constraints, base: int, op: str) -> int:
        """Writes the version, then creates its log file, which fails if that number exists."""
        rows = df.select("*")
        check(rows, rules)
        seq = base + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/v{seq}-{time.time_ns()}")
        made = sorted(str(s.getPath().getName()) for s in self._fs.listStatus(self._at(f"{self.path}/{name}")) if str(s.getPath().getName()).startswith(f"v{seq}-"))[-1]
        line = json.dumps({"seq": seq, "at": time.time(), "folder": made, "op": op, "rules": rules.__dict__})
        try:
            out = self._fs.create(self._at(f"{self.path}/{name}/_log/{seq:020d}"), False)
        except Exception as e:
            raise Conflict(f"{name} has a version {seq} already") from e
        out.write(bytearray(line.encode()))
        out.close()
        return seq

    def last(self, name: str) -> dict:
        log = self.log(name)
        if not log or log[-1]["op"] == "drop":
            raise NoSuchTable(name)
        return log[-1]

    # --- reading ---

    def read(self, name: str, version: int | None = None, as_of: float | None = None) -> DataFrame:
        """The last version, that of a commit number, or the last one at a time."""
        log = self.log(name)
        if version is not None:
            log = [x for x in log if x["seq"] == version]
        elif as_of is not None:
            log = [x for x in log if x["at"] <= as_of]
        if not log or log[-1]["op"] == "drop":
            raise NoSuchTable(f"{name} has no such version")
        return self.spark.read.parquet(f"{self.path}/{name}/{log[-1]['folder']}")

    def rules(self, name: str) -> Constraints:
        return Constraints(**self.last(name)["rules"])

    # --- statements ---

    def create(self, name: str, df: DataFrame, **rules) -> int:
        r = Constraints(**rules)
        log = self.log(name)
        if log and log[-1]["op"] != "drop":
            raise ConstraintError(f"table {name} already exists")
        return self.commit(name, generated(df, r), r, log[-1]["seq"] if log else 0, "create")

    def _next(self, name: str, op: str, make: Callable[[DataFrame, Constraints], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """make gives the next version and the affected rows, which are returned (RETURNING)."""
        last, rules = self.last(name), self.rules(name)
        rows, affected = make(self.read(name), rules)
        self.commit(name, rows, rules, last["seq"], op)
        self.changes = affected.count()
        self.total_changes += self.changes
        return affected

    def insert(self, name: str, new: DataFrame, on_conflict: str = "abort", update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
        """on_conflict: abort, ignore, replace, or update (with columns over `old` and `excluded`)."""

        def make(old: DataFrame, r: Constraints):
            rows = generated(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes if c not in r.generated], *[F.lit(None).alias(c) for c in r.generated]), r).select(old.columns)
            if on_conflict == "abort" or not r.key:
                return old.unionByName(rows), rows
            rows = _last_per_key(rows, r.key) if on_conflict == "replace" else rows.dropDuplicates(r.key)
            if on_conflict == "replace":
                return old.join(rows, r.key, "left_anti").unionByName(rows), rows
            fresh = rows.join(old, r.key, "left_anti").select(old.columns)
            if on_conflict == "ignore":
                return old.unionByName(fresh), fresh
            on = F.lit(True)
            for k in r.key:
                on = on & (F.col(f"old.{k}") == F.col(f"excluded.{k}"))
            hit = F.col(f"excluded.{r.key[0]}").isNotNull() & (where if where is not None else F.lit(True))
            both = old.alias("old").join(rows.alias("excluded"), on, "left")
            merged = both.select(*[F.when(hit, update[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in update else F.col(f"old.{c}") for c in old.columns])
            return merged.unionByName(fresh), rows

        return self._next(name, "insert", make)

    def update(self, name: str, set_: dict[str, Column], where: Column) -> DataFrame:
        def make(old: DataFrame, r: Constraints):
            hit = F.coalesce(where, F.lit(False))
            rows = generated(old.select(*[F.when(hit, v).otherwise(F.col(c)).alias(c) if (v := set_.get(c)) is not None else F.col(c) for c in old.columns]), r)
            after = generated(old.filter(hit).select(*[set_.get(c, F.col(c)).alias(c) for c in old.columns]), r)
            return rows, after

        return self._next(name, "update", make)

    def update_from(self, name: str, source: DataFrame, on: list[str], set_: dict[str, Column]) -> DataFrame:
        """UPDATE ... FROM: columns over `old` and `src`; each row has one match at most."""

        def make(old: DataFrame, r: Constraints):
            both = old.alias("old").join(source.withColumn("_hit", F.lit(True)).alias("src"), on, "left")
            pick = [F.when(F.col("_hit"), set_[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in set_ else (F.col(c) if c in on else F.col(f"old.{c}")) for c in old.columns]
            return both.select(*pick), both.filter("_hit").select(*pick)

        return self._next(name, "update", make)

    def delete(self, name: str, where: Column) -> DataFrame:
        hit = F.coalesce(where, F.lit(False))
        return self._next(name, "delete", lambda old, r: (old.filter(~hit), old.filter(hit)))

    def drop(self, name: str) -> None:
        last = self.last(name)
        self.commit(name, self.read(name).limit(0), Constraints(), last["seq"], "drop")

    def alter(self, name: str, add: dict[str, Column] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> int:
        last, r = self.last(name), self.rules(name)
        df = self.read(name).withColumns(add or {}).drop(*(drop or [])).withColumnsRenamed(rename or {})
        r.key = [(rename or {}).get(k, k) for k in r.key]
        return self.commit(name, df, r, last["seq"], "alter")

    def tables(self) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._at(self.path))]
        return sorted(n for n in names if (log := self.log(n)) and log[-1]["op"] != "drop")

    def transaction(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Remembers where tables stand; rollback and savepoints put those versions back as new commits."""

    def __init__(self, store: Store):
        self.store, self.marks = store, {"": {n: store.last(n)["seq"] for n in store.tables()}}

    def savepoint(self, name: str) -> None:
        self.marks[name] = {n: self.store.last(n)["seq"] for n in self.store.tables()}

    def rollback(self, name: str = "") -> None:
        s = self.store
        for n in s.tables():
            last = s.last(n)
            seq = self.marks[name].get(n)
            if seq is None:
                s.drop(n)
            elif seq != last["seq"]:
                rules = next(x["rules"] for x in s.log(n) if x["seq"] == seq)
                s.commit(n, s.read(n, version=seq), Constraints(**rules), last["seq"], "rollback")


def generated(df: DataFrame, r: Constraints) -> DataFrame:
    for c, e in r.generated.items():
        df = df.withColumn(c, F.expr(e))
    return df


def _last_per_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows of a statement with one key, one (the largest by its other columns, as rows have no order)."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")) if rest else rows.dropDuplicates(key)
    return best.select(*key, "_r.*").select(rows.columns) if rest else best


def check(rows: DataFrame, r: Constraints) -> None:
    """NULL keys never clash; one aggregate for keys, one for the rest."""
    if r.key:
        known = rows
        for k in r.key:
            known = known.filter(F.col(k).isNotNull())
        if not known.groupBy(*r.key).count().filter("count > 1").isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(r.key)}")
    bad = [F.col(c).isNull() for c in r.not_null] + [F.expr(f"NOT ({e})") for e in r.check]
    if bad:
        broken = rows.agg(*[F.count(F.when(b, 1)).alias(f"b{i}") for i, b in enumerate(bad)]).first()
        names = [f"NOT NULL constraint failed: {c}" for c in r.not_null] + [f"CHECK constraint failed: {e}" for e in r.check]
        for i, n in enumerate(names):
            if broken[i]:
                raise ConstraintError(n)


def fk_violations(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows with a key that no parent has; NULL keys are no violation."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def fk_delete(child: DataFrame, gone: DataFrame, fk: str, pk: str, action: str, default=None) -> DataFrame:
    """The child table after its parents in gone: cascade, set null, set default, restrict or no action."""
    keys = gone.select(F.col(pk).alias(fk)).distinct()
    if action == "cascade":
        return child.join(keys, fk, "left_anti").select(child.columns)
    if action in ("restrict", "no action"):
        if not child.join(keys, fk, "left_semi").isEmpty():
            raise ConstraintError("FOREIGN KEY constraint failed")
        return child
    marked = child.join(keys.withColumn("_gone", F.lit(True)), fk, "left")
    value = F.lit(default if action == "set default" else None)
    return marked.withColumn(fk, F.when(F.col("_gone"), value).otherwise(F.col(fk))).select(child.columns)


# --- change sets ---------------------------------------------------------------------------------------------------


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """op (insert, update, delete), key columns, old and new rows as structs: a full join on the key."""
    rest = [c for c in before.columns if c not in key]
    side = lambda df, n: df.select(*key, F.struct(*rest).alias(n))
    both = side(before, "old").join(side(after, "new"), key, "full")
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.withColumn("op", op).filter(F.col("op").isNotNull())


def invert(changes: DataFrame) -> DataFrame:
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise("update")
    keys = [c for c in changes.columns if c not in ("op", "old", "new")]
    return changes.select(*keys, F.col("new").alias("old"), F.col("old").alias("new"), op.alias("op"))


def concat(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """The change set of doing one after the other."""
    both = first.withColumnsRenamed({"old": "o1", "new": "n1", "op": "p1"}).join(second.withColumnsRenamed({"old": "o2", "new": "n2", "op": "p2"}), key, "full")
    old = F.when(F.col("p1").isNotNull(), F.col("o1")).otherwise(F.col("o2"))
    new = F.when(F.col("p2").isNotNull(), F.col("n2")).otherwise(F.col("n1"))
    out = both.select(*key, old.alias("old"), new.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))
    return out.withColumn("op", F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update"))


def apply(table: DataFrame, changes: DataFrame, key: list[str], on_conflict: str = "omit") -> tuple[DataFrame, DataFrame]:
    """The changed table and the changes that met other rows than they expected: data, notfound or conflict. These are
    left out (omit), done anyway (replace), or an error (abort)."""
    rest = [c for c in table.columns if c not in key]
    rows = table.select(*key, F.struct(*rest).alias("now"))
    both = rows.join(changes, key, "full")
    clash = F.when((F.col("op") == "insert") & F.col("now").isNotNull(), "conflict").when((F.col("op") != "insert") & F.col("now").isNull(), "notfound").when((F.col("op") != "insert") & ~F.col("now").eqNullSafe(F.col("old")), "data")
    both = both.withColumn("clash", clash)
    if on_conflict == "abort" and not both.filter(F.col("clash").isNotNull()).isEmpty():
        raise ConstraintError("a change conflicts")
    done = F.col("op").isNotNull() & (F.col("clash").isNull() if on_conflict == "omit" else (F.coalesce("clash", F.lit("")) != "notfound"))
    after = both.withColumn("now", F.when(done, F.col("new")).otherwise(F.col("now"))).filter(F.col("now").isNotNull())
    return after.select(*key, "now.*").select(table.columns), both.filter(F.col("clash").isNotNull()).select(*key, "op", "clash")
