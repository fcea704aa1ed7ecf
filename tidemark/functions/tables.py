"""Table functions: steps that turn the rows of a group into rows of their own.

A function is a Python class with ``eval`` (and ``analyze``, where its result's columns depend on its arguments), registered
under a name. It is called with a table that Spark partitions and sorts for it, row by row in order, so it needs no memory
for its group.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

FUNCTIONS: dict[str, type] = {}


def function(name: str):
    """Registers a class as the table function of that name."""

    def keep(cls: type) -> type:
        FUNCTIONS[name] = cls
        return cls

    return keep


@function("runs")
class Runs:
    """runs(table, by, order, value): a row for each run of equal values in a group: the group's key, value, first and last of the order, n."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [a.value for a in (by, order, value) if a.value not in kinds]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        schema = StructType().add(by.value, kinds[by.value]).add(value.value, kinds[value.value]).add("first", kinds[order.value]).add("last", kinds[order.value]).add("n", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self) -> None:
        self.run = None

    def eval(self, row, by: str, order: str, value: str) -> Iterator[tuple]:
        if self.run and self.run[1] == row[value]:
            self.run[3], self.run[4] = row[order], self.run[4] + 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row[by], row[value], row[order], row[order], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


@function("pieces")
class Pieces:
    """pieces(table, column, separator): every row once for each piece of a text, with its number from 1 and the piece, behind its own columns."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, separator: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType([*rows.dataType.fields]).add("number", LongType()).add("piece", StringType())
        return AnalyzeResult(schema)

    def eval(self, row, column: str, separator: str) -> Iterator[tuple]:
        for i, piece in enumerate((row[column] or "").split(separator), 1):
            yield (*row, i, piece)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL under their names."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))


def applied(df: DataFrame, step: dict) -> DataFrame:
    """A step {"type": "table_function", "name", "args": [...], "partition_by": [...], "order_by": [...]}.

    Functions that name their own partitioning (as ``runs``) are given the table as it is.
    """
    name = step.get("name")
    if name not in FUNCTIONS:
        raise ValueError(f"unknown table function {name!r}")
    table = df.asTable()
    if step.get("partition_by"):
        table = table.partitionBy(*step["partition_by"])
        table = table.orderBy(*step["order_by"]) if step.get("order_by") else table
    return udtf(FUNCTIONS[name])(table, *map(F.lit, step.get("args", [])))
