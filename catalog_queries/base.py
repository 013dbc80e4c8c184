"""Registry and the views that derive catalog entities from the supplied tables.

A binding is plain SQL that both engines accept: Spark registers it as a
temporary view, the checking SQL gets the same text as a WITH clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.operators.keyed import shuffled

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Their bindings add long texts; the files, which the optimizer judges by, are many times smaller.
ENTITIES = {"part", "customer"}

AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"



def as_of(text: str = "2001-12-01 00:00:00"):
    """The explicit "now" as a time-zone-free column."""
    return F.lit(text).cast("timestamp_ntz")


def events_as_of():
    return as_of("2024-02-01 00:00:00")


BINDINGS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Views:
    """Bindings and tables of one data folder as DataFrames, made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name in ENTITIES:
                    df = shuffled(df)
            elif name in BINDINGS:
                sql = BINDINGS[name]
                for used in names_in(sql):
                    self.get(used)
                df = self.spark.sql(sql)
                for f in df.schema.fields:
                    if f.dataType.typeName() == "timestamp":
                        df = df.withColumn(f.name, df[f.name].cast("timestamp_ntz"))
            else:
                raise AttributeError(name)
            df.createOrReplaceTempView(name)
            self._made[name] = df
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and bindings."""
        for used in names_in(text):
            self.get(used)
        return self.spark.sql(text)


def names_in(sql: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_]+\b", sql))
    return [n for n in list(BINDINGS) + TABLES if n in words]


def with_bindings(sql: str) -> str:
    """Prefix the bindings a query names, in dependency order."""
    needed: list[str] = []

    def visit(text):
        for name in names_in(text):
            if name in BINDINGS and name not in needed:
                visit(BINDINGS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in needed)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame``, with checking SQL where there is any."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
