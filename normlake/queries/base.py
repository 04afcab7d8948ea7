"""Registry of queries and their SQL twins.

A fixture is one SELECT in a dialect both engines read; ``{table}`` names a driver table. Spark reads the
parquet file behind it, DuckDB the view of that name, so both sides start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from normlake.session import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

DEALT = 2 << 20

_TABLE = re.compile(r"\{(" + "|".join(TABLES) + r")\}")
FIXTURES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixture(name: str, sql: str) -> None:
    FIXTURES[name] = sql


@dataclass
class Inputs:
    """Fixture and table access of one query run."""

    spark: SparkSession
    folder: str
    held: dict[str, DataFrame] = field(default_factory=dict)

    def hold(self, name: str) -> None:
        """Makes a fixture once; what is asked for later, other fixtures included, reads its files."""
        self.held[name] = stored(getattr(self, name), name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.held:
            return self.held[name]
        if name in FIXTURES:
            return self.spark.sql(self._expand(name))
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def _expand(self, name: str) -> str:
        needed = _closure([name])
        text = FIXTURES[name]
        made = {n: f"SELECT * FROM parquet.`{df.stored_at}`" for n, df in self.held.items()}
        ctes = [f"{n} AS ({made.get(n, FIXTURES[n])})" for n in needed if n != name]
        full = (f"WITH {', '.join(ctes)} " if ctes else "") + text
        return _TABLE.sub(lambda m: f"parquet.`{self.folder}/{m.group(1)}.parquet`", full)


def _closure(names: list[str]) -> list[str]:
    """Fixtures used by the named ones, dependencies first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in FIXTURES:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", FIXTURES[name]):
                visit(other)
        done.append(name)

    for name in names:
        visit(name)
    return done


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Texts of a table that comes as a few unsplit files, dealt out before costly work on each row.

    A task's Arrow batches end with its rows, so that tasks of ``DEALT`` bytes of files bound what the JVM and the workers
    beside it hold, whatever the size of the table and of the session's batches.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    wanted = -(-known // DEALT) if known < 1 << 50 else 0  # a larger one stands for an unknown size
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, wanted), key)


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` may use any fixture name as a table."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle)
        return fn

    return register


def with_fixtures(sql: str) -> str:
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({FIXTURES[n]})" for n in _closure(used)]
    body = sql.strip()
    if ctes:
        if body.upper().startswith("WITH RECURSIVE "):
            body = "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[15:]
        elif body.upper().startswith("WITH "):
            body = "WITH " + ", ".join(ctes) + ", " + body[5:]
        else:
            body = "WITH " + ", ".join(ctes) + " " + body
    return _TABLE.sub(r"\1", body)


def values_sql(columns: list[str], rows: list[tuple]) -> str:
    """A literal table both engines read."""

    def lit(v):
        if v is None:
            return "CAST(NULL AS VARCHAR(100))"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"
