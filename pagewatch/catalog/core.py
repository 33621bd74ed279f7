"""Query registry: each case pairs a Spark job with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagewatch.catalog.sources import BASE_TABLES, VIEWS
from pagewatch.session import read_spread


# Tables whose texts cost far more to process than to move.
TEXT_TABLES = ("documents", "pages", "conversations")


class Tables:
    """The driver's tables and the domain views derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE_TABLES:
                path = f"{self.folder}/{name}.parquet"
                text = name in TEXT_TABLES
                self._made[name] = read_spread(self.spark, path) if text else self.spark.read.parquet(path)
            else:
                sql, deps = VIEWS[name]
                self._made[name] = self.sql(sql, *deps)
        return self._made[name]

    def sql(self, text: str, *names: str) -> DataFrame:
        """Run ``text`` over the named tables; they are registered anew each time."""
        frames = {name: self(name) for name in names}
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)


def needed(name: str) -> list[str]:
    """``name`` and everything it is built from, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][1] if n in VIEWS else ():
            visit(dep)
        order.append(n)

    visit(name)
    return order


def with_views(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """SQL text with the domain views it uses as CTEs, then the ``extra`` CTEs."""
    parts: list[str] = []
    done: set[str] = set()
    for name in names:
        for dep in needed(name):
            if dep in VIEWS and dep not in done:
                done.add(dep)
                parts.append(f"{dep} as ({VIEWS[dep][0]})")
    parts.extend(f"{n} as ({sql})" for n, sql in extra)
    return (f"with {', '.join(parts)} " if parts else "") + body


@dataclass(frozen=True)
class Case:
    run: Callable[[Tables], DataFrame]
    oracle: str | None


CASES: dict[str, Case] = {}


def plain_counts(sql: str) -> str:
    """Write ``count_if(x)`` as a filtered count, which has the type Spark's has."""
    while (start := sql.find("count_if(")) >= 0:
        end, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:start]}count(*) filter (where {sql[start + len('count_if('):end - 1]}){sql[end:]}"
    return sql


def case(name: str, oracle: str | None = None):
    def register(run: Callable[[Tables], DataFrame]):
        if name in CASES:
            raise ValueError(f"duplicate query {name}")
        CASES[name] = Case(run, plain_counts(oracle) if oracle else None)
        return run

    return register


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return CASES[name].run(Tables(spark, folder))

    return run
