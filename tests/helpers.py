from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def apply(spark: SparkSession, texts: list[str], build: Callable[[Column], Column]) -> list:
    """Evaluate a column expression for each text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = df.select("i", build(F.col("x")).alias("y")).collect()
    return [plain(r.y) for r in sorted(rows, key=lambda r: r.i)]


def plain(value):
    if isinstance(value, list):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value
