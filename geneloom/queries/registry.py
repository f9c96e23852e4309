"""Named queries over the driver tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, tune


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


class Tables:
    """``t.orders`` reads the parquet table of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def texts(self) -> DataFrame:
        """The documents, spread over all cores for CPU-heavy text work."""
        return spread(self.spark.read.parquet(f"{self.sf_dir}/documents.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``build(t: Tables) -> DataFrame`` under ``name``."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(tune(spark), sf_dir))

        REGISTRY[name] = Query(name, run, oracle, tuple(covers.split()))
        return build

    return wrap


def scalar(name: str, covers: str, table: str, keys: str, raw: dict[str, str],
           outs: dict[str, tuple[Callable[..., Column], str]]) -> None:
    """A row-wise query: inputs ``raw`` are SQL text both engines understand.

    ``outs`` maps an output name to (function of the raw columns, SQL over the raw columns).
    """
    key_list = [k.strip() for k in keys.split(",")]
    inner = ", ".join([*key_list, *[f"{sql} AS {alias}" for alias, sql in raw.items()]])
    outer = ", ".join([*key_list, *[f"{sql} AS {alias}" for alias, (_, sql) in outs.items()]])

    def build(t: Tables) -> DataFrame:
        df = getattr(t, "texts" if table == "documents" else table).select(*key_list, *[F.expr(sql).alias(alias) for alias, sql in raw.items()])
        cols = {alias: F.col(alias) for alias in raw}
        return df.select(*key_list, *[fn(**cols).alias(out) for out, (fn, _) in outs.items()])

    query(name, covers, f"SELECT {outer} FROM (SELECT {inner} FROM {table}) q")(build)


def r(c, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
