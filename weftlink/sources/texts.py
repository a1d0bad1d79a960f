"""Plain documents with marked mentions, and labelled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each file under a path is one document, named by its file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of a labelled corpus: documents begin with ``-DOCSTART- (<id> …)``, then one token a line.
    The text source makes each document a record. Documents without such a head are skipped."""
    doc = spark.read.option("lineSep", "-DOCSTART-").text(path)
    doc = doc.select(F.regexp_extract("value", r"^\s*\((\w+)\s[^\n]*?\)\s*(?:\n|$)", 1).alias("doc_id"), "value").where("doc_id <> ''")
    lines = doc.select("doc_id", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = lines.where("at > 0").withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return lines.select("doc_id", number.alias("line_no"), "line")


def labelled_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, token, mark, sf, gold) of (doc_id, line_no, line) rows, line_no counting from 0 without gaps.

    Tab-separated columns: token, ``B`` or ``I``, the full mention, the entity's page or ``--NME--``, [not read], entity id.
    mark is B where a mention starts, I inside one that has an entity, and NULL for all else, which ends a mention.
    """
    parts = F.split("line", "\t")
    named = (F.size(parts) >= 4) & (parts[3] != "--NME--")
    rows = lines.select(
        "doc_id", "line_no",
        F.lower(F.regexp_replace(parts[0], r"(?U)^\s+|\s+$", "")).alias("token"),
        F.when(named, F.when(parts[1] == "B", "B").otherwise("I")).alias("mark"),
        F.when(named & (parts[1] == "B"), F.lower(parts[2])).alias("sf"),
        F.when(named & (parts[1] == "B"), F.try_element_at(parts, F.lit(6)).try_cast("long")).alias("gold"),
    )
    return rows


def labelled_mentions(tokens: DataFrame) -> DataFrame:
    """(doc_id, sf, start, end, gold): a mention reaches from its B to the last row before the next B or break.

    Gaps and islands: B rows and breaks are numbered, an island is kept if a B begins it. A mention that starts at the first
    token counts like any other.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("mark").isNull() | (F.col("mark") == "B")).cast("int")
    rows = tokens.withColumn("island", F.sum(opens).over(order))
    islands = rows.groupBy("doc_id", "island").agg(
        F.max("sf").alias("sf"), F.max("gold").alias("gold"), F.min("line_no").alias("start"),
        (F.max("line_no") + 1).alias("end"), F.max((F.col("mark") == "B").cast("int")).alias("starts"),
    )
    return islands.where("starts = 1").select("doc_id", "sf", F.col("start").cast("int"), F.col("end").cast("int"), "gold")


def labelled_documents(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, tokens, mentions), gold (doc_id, sf, entity_id)) of labelled tokens. Of several gold entities of a form in
    a document, the last counts."""
    found = labelled_mentions(tokens)
    words = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "token"))).alias("t"))
    words = words.select("doc_id", F.transform("t", lambda x: x["token"]).alias("tokens"))
    marks = found.groupBy("doc_id").agg(F.collect_list(F.struct("sf", "start", "end")).alias("mentions"))
    gold = found.where("gold is not null").groupBy("doc_id", "sf").agg(F.max_by("gold", "start").alias("entity_id"))
    return words.join(marks, "doc_id"), gold


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and gold of a labelled corpus file or directory."""
    return labelled_documents(labelled_tokens(read_labelled_lines(spark, path)))
