"""Window cutting as a function in the FROM clause of SQL."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StructType


@udtf
class CutWindows:
    """cut_windows(rows => TABLE(t) PARTITION BY (...) ORDER BY k, size => n [, stride => m] [, whole => 'column'])

    The rows of each series in whole windows of n, with win and step. With whole, windows in which
    that column is null somewhere are left out; they keep their number. A task holds one window at a time.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, stride: AnalyzeArgument | None = None, whole: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("rows must be a TABLE argument")
        for name, arg in (("size", size), ("stride", stride)):
            if arg is not None and (not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value < 1):
                raise ValueError(f"{name} must be a whole number from 1")
        made = StructType([f for f in rows.dataType.fields if f.name not in ("win", "step")])
        return AnalyzeResult(made.add("win", LongType()).add("step", LongType()))

    def __init__(self):
        self.held: deque = deque()
        self.at = 0

    def eval(self, rows: Row, size: int, stride: int | None = None, whole: str | None = None):
        stride = stride or size
        kept = tuple(v for n, v in zip(rows.__fields__, rows, strict=True) if n not in ("win", "step"))
        self.held.append((kept, whole is not None and rows[whole] is None))
        self.at += 1
        if len(self.held) > size:
            self.held.popleft()
        start = self.at - size
        if start >= 0 and start % stride == 0 and not any(gap for _, gap in self.held):
            for step, (row, _) in enumerate(self.held):
                yield (*row, start // stride, step)


def register(spark: SparkSession) -> None:
    spark.udtf.register("cut_windows", CutWindows)
