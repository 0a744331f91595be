"""Table functions that take a table: rows of one key in order, one after the other."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from brindle.session import ship


class Rises:
    """Runs of rows whose value rises from row to row, for each key: rises(TABLE(t), key, time, value, least).

    The key's type comes from the table, and the function says itself how the rows must be dealt and ordered. Rows go by
    one at a time; what is held of a key is its present run's ends.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, value: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument is a table")
        names = [a.value for a in (key, time, value)]
        if any(n not in table.dataType.names for n in names):
            raise ValueError(f"the table has no columns {names}")
        if not isinstance(least.value, int) or least.value < 1:
            raise ValueError("the least length of a run is a whole number above 0")
        schema = StructType([StructField(names[0], table.dataType[names[0]].dataType), StructField("run", LongType()), StructField("length", LongType()), StructField("low", DoubleType()), StructField("high", DoubleType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1]), OrderingColumn(names[2])])

    def __init__(self) -> None:
        self.run, self.length, self.low, self.high, self.key, self.least = 0, 0, None, None, None, 1

    def eval(self, row: Row, key: str, time: str, value: str, least: int) -> Iterator[tuple]:
        self.key, self.least, v = row[key], least, row[value]
        if v is None or self.high is None or v <= self.high:
            yield from self._ended()
            self.length, self.low = 0, None
        if v is not None:
            self.length, self.low, self.high = self.length + 1, (v if self.low is None else self.low), v
        else:
            self.high = None

    def terminate(self) -> Iterator[tuple]:
        yield from self._ended()

    def _ended(self) -> Iterator[tuple]:
        if self.length >= self.least:
            self.run += 1
            yield self.key, self.run, self.length, float(self.low), float(self.high)


def register(spark: SparkSession) -> None:
    """Make the functions of this module known to SQL."""
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.udtf.register("rises", udtf(Rises))
