"""Records of large JSON array and CSV documents, read by byte ranges.

Spark's text reader splits a file at any byte when it is given a separator that every record ends with. Whether a piece
starts inside a string, and how deep it is nested, is a running sum of what the pieces before it hold; such sums are taken
per byte range and then over the few ranges of a file. So one file of any size is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.prefix import prior_sums
from assaylake.session import frozen


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, start, at, value): pieces between separators; ``start`` is the byte range, ``at`` grows within it."""
    t = spark.read.option("lineSep", separator).text(path)
    # as a table: a file's name is written once and not beside each of its pieces
    return frozen(t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"), "pieces")


def _before(df: DataFrame, name: str, amount: Column) -> DataFrame:
    """Sum of an amount over the earlier pieces of the file."""
    return prior_sums(df, ["file"], "at", {name: amount}, bucket="start")


def _joined(df: DataFrame, separator: str) -> DataFrame:
    """(file, no, text, whole): the pieces up to and including one with ``ends`` as one text; ``whole`` if it has one."""
    parts = F.array_sort(F.collect_list(F.struct("start", "at", "value")))
    text = F.array_join(F.transform(parts, lambda p: p["value"]), separator)
    return _before(df, "no", F.col("ends").cast("bigint")).groupBy("file", "no").agg(text.alias("text"), F.max("ends").alias("whole"))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def json_records(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, no, bare, record): the objects of a JSON array as texts; the array is the document (``bare``) or its ``field``.

    A file may hold either form. A record ends with a brace, so pieces end at braces; braces and quotes inside strings
    are told apart by the running count of quotes. A document that is cut off, or a record that is not JSON, is an
    error; what stands beside the array is not parsed. An empty file has no records.
    """
    quote = '"'
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # no column: it would be dealt out beside the value
    pieces = _pieces(spark, path, "}")
    # the first character of the document tells the form: records end at depth 1 of a list, at depth 2 of an object
    first = frozen(pieces.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").groupBy("file").agg(F.min(F.struct("start", "at", F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1).alias("c")))["c"].alias("opening")), "openings")
    p = _before(pieces, "quotes", _count(bare, quote))
    odd = lambda n: n % 2 == 1
    p = p.withColumn("inside", odd(F.col("quotes") + _count(bare, quote)))
    shape = F.regexp_replace(F.concat(F.when(odd(F.col("quotes")), quote).otherwise(""), bare, F.when(F.col("inside"), quote).otherwise("")), '"[^"]*"', "")
    deeper = _count(shape, "{") + _count(shape, "[") - _count(shape, "]") - F.when(F.col("inside"), 0).otherwise(1)
    p = _before(p.withColumn("deeper", deeper).drop("quotes"), "depth", F.col("deeper"))
    wrapped = F.col("opening") == "{"
    p = p.join(first, "file").withColumn("ends", ~F.col("inside") & (F.col("depth") + F.col("deeper") == F.when(wrapped, 2).otherwise(1)))
    r = frozen(_joined(p, "}").join(first, "file"), "records")
    key = rf'(?s)^.*?"{field}"\s*:\s*\[\s*(?=\{{)'
    # what is left after the last record must close the array
    tail = ~F.col("whole") & F.col("text").rlike(r"(?s)^\s*(\[\s*\]|\]|\{.*\[\s*\])")
    # a row per file, kept as tables of known size: the texts are not moved to meet them where files are few
    from_field = frozen(r.groupBy("file").agg(F.min(F.when(F.col("whole") & (~wrapped | F.col("text").rlike(key)), F.col("no"))).alias("low"),
                                              (F.first("opening").isin("[", "{") & F.bool_or(tail)).alias("sound")), "files")
    j = r.join(from_field, "file")
    past = frozen(j.filter(wrapped & (F.col("no") > F.col("low")) & F.col("text").rlike(r"^\s*\]")).groupBy("file").agg(F.min("no").alias("high")), "ends")
    j = j.join(past, "file", "left")
    fail = lambda kind: F.raise_error(F.lit("cannot parse import: not a JSON document")).cast(kind)
    used = F.col("whole") & (F.col("no") >= F.col("low")) & (F.col("high").isNull() | (F.col("no") < F.col("high")))
    lead = F.when(~wrapped, F.regexp_replace("text", r"^[\s,\[]+", "")).when(F.col("no") == F.col("low"), F.regexp_replace("text", key, "")).otherwise(F.regexp_replace("text", r"^[\s,]+", ""))
    record = F.concat(lead, F.lit("}"))
    checked = F.when(F.try_parse_json(record).isNull(), fail("string")).otherwise(record)
    return j.filter(F.when(~F.col("sound"), fail("boolean")).otherwise(used)).select("file", "no", (~wrapped).alias("bare"), checked.alias("record"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all columns text; quoted values may hold line breaks, quotes are doubled.

    A line break ends a record where the number of quotes before it is even. All files have the first file's header. A
    value that is missing or empty without quotes is null, as it is for Spark's reader.
    """
    p = _before(_pieces(spark, path, "\n"), "quotes", _count(F.col("value"), '"'))
    p = p.withColumn("ends", (F.col("quotes") + _count(F.col("value"), '"')) % 2 == 0)
    r = _joined(p.drop("quotes"), "\n").withColumn("text", F.regexp_replace("text", r"\r$", ""))
    head = r.filter("no = 0").orderBy("file").first()
    if head is None:
        return spark.createDataFrame([], "value string").drop("value")
    names = next(iter(spark.createDataFrame([(head["text"],)], "t string").select(F.from_csv("t", ", ".join(f"c{i} string" for i in range(head["text"].count(",") + 1)), {"escape": '"'}).alias("h")).first()))
    names = [n for n in names if n is not None]
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    bad = F.when(~F.col("whole"), F.raise_error(F.lit("cannot parse import: a quoted value does not end")).cast("string")).otherwise(F.col("text"))
    body = r.filter("no > 0").select(bad.alias("text")).filter("text <> ''")
    return body.select(F.from_csv("text", schema, {"escape": '"', "multiLine": "true", "mode": "FAILFAST"}).alias("r")).select("r.*")
