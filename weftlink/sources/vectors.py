"""Word vectors in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec array<double>) of a text file of ``word x1 … xd`` lines with a header line ``n d``, which is recognised by
    its two whole numbers. Rows whose numbers do not parse, or are not all there, have NULL elements and can be told by
    ``usable``; words stay as they are, lower case or not."""
    line = spark.read.text(path).select(F.rtrim("value").alias("value")).where("value <> ''")
    parts = line.where(~F.col("value").rlike(r"^\d+ \d+$")).select(F.split("value", " ").alias("p"))
    numbers = F.transform(F.slice("p", 2, F.size("p")), lambda x: x.try_cast("double"))
    return parts.where(F.size("p") > 1).select(F.col("p")[0].alias("word"), numbers.alias("vec"))
