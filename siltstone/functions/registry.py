"""Own functions by name and number of arguments: scalar, aggregate and table functions, all in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Functions:
    """Looks for the exact number of arguments first, then for a variadic function (-1)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[tuple[str, int], Callable[..., Column]] = {}

    def add(self, name: str, arity: int, make: Callable[..., Column]) -> None:
        self.known[name.upper(), arity] = make

    def call(self, name: str, *args: Column) -> Column:
        make = self.known.get((name.upper(), len(args))) or self.known.get((name.upper(), -1))
        if make is None:
            raise LookupError(f"no such function: {name}/{len(args)}")
        return make(*args)

    def scalar(self, name: str, arity: int, kind: str, f: Callable, deterministic: bool = True) -> None:
        """f of values; NULL arguments give NULL."""

        @F.arrow_udf(kind)
        def run(*cols: pa.Array) -> pa.Array:
            rows = zip(*[x.to_pylist() for x in cols], strict=True)
            return pa.array([None if any(v is None for v in row) else f(*row) for row in rows])

        self.add(name, arity, run if deterministic else run.asNondeterministic())

    def aggregate(self, name: str, arity: int, kind: str, start: Callable, step: Callable, finish: Callable) -> None:
        """Over the rows of a group, which one task holds; also over windows."""

        @F.arrow_udf(kind)
        def run(x: pa.Array) -> float:
            state = start()
            for v in x:
                state = step(state, v.as_py())
            return finish(state)

        self.add(name, arity, run)

    def table(self, name: str, schema: str, rows: Callable) -> None:
        class Rows:
            def eval(self, *args):
                for r in rows(*args):
                    yield r if isinstance(r, tuple) else (r,)

        self.spark.udtf.register(name, F.udtf(Rows, returnType=schema))


def collation_key(compare_key: Callable[[str], str]) -> Callable[[Column], Column]:
    """A collation as the key that texts sort by."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else compare_key(v) for v in x.to_pylist()], pa.string())

    return run
