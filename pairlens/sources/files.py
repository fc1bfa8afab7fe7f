"""Files that the debugger reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.numbering import numbered_rows
from pairlens.model import CandidateSet, KeyedTable

CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N"}
BAD = "_bad_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True, sample: float = 1.0, bad: str | None = None) -> DataFrame:
    r"""A table from CSV with a header: fields in quotes may hold commas, quotes (doubled) and line breaks; \N is null.

    Without a schema, types are inferred from a share of the rows (sample). With multi_line, a file is read by one task, as only
    its start is known to be outside quotes; without it, large files are split, and values have no line breaks. bad: a column
    for the whole text of records that do not fit the schema (their other fields are null where they do not), null for good ones.
    """
    reader = spark.read.options(**CSV).option("multiLine", multi_line)
    if schema is None:
        schema = reader.option("inferSchema", True).option("samplingRatio", sample).csv(path).schema
    if bad is None:
        return reader.schema(schema).csv(path)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return reader.schema(T.StructType([*kind.fields, T.StructField(bad, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("columnPruning", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table as read_csv reads it back."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_table(spark: SparkSession, path: str, key: str, schema: T.StructType | str | None = None) -> KeyedTable:
    """A keyed table from Parquet, or from CSV with a header; without a schema, CSV types are inferred."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, schema)
    if key not in df.columns:
        raise ValueError(f"{path} has no column {key}")
    return KeyedTable(df, key)


def good_and_bad(df: DataFrame, bad: str = BAD) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and those that do not with their whole text. df: from read_csv with bad."""
    return df.where(F.col(bad).isNull()).drop(bad), df.where(F.col(bad).isNotNull())


def read_candidates(spark: SparkSession, path: str, left_key: str, right_key: str) -> CandidateSet:
    return CandidateSet(read_table(spark, path, left_key).df, left_key, right_key)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """id1, id2 of known matches: row numbers of the two tables, from 1."""
    return spark.read.option("header", True).schema("id1 long, id2 long").csv(path)


def gold_keys(gold: DataFrame, left: KeyedTable, right: KeyedTable, left_order: str, right_order: str) -> DataFrame:
    """lkey, rkey of known matches given by row numbers in the order of a column, whose ties are put in the order of the keys."""

    def numbered(table: KeyedTable, order: str, n: str, k: str) -> DataFrame:
        rows = table.df.select(F.col(f"`{order}`").alias("o"), F.col(f"`{table.key}`").alias(k))
        return numbered_rows(rows, ["o", k], n).select(n, k)

    return gold.join(numbered(left, left_order, "id1", "lkey"), "id1").join(numbered(right, right_order, "id2", "rkey"), "id2").select("lkey", "rkey")


def lower_and_limit(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in the order of a column, all text in lower case."""
    texts = {f.name: F.lower(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.StringType)}
    first = df.orderBy(order).limit(n)
    return first.withColumns(texts) if texts else first


def write_lists(recommended: DataFrame, path: str) -> None:
    """Recommendations as Parquet, a folder for each configuration."""
    recommended.write.mode("overwrite").partitionBy("config").parquet(path)


def list_lines(recommended: DataFrame) -> DataFrame:
    """config, rank, value: the readable form of each suggested pair, as one text of five lines."""
    fields = lambda c: F.concat_ws(", ", c)
    text = F.concat_ws("\n", F.concat(F.lit("======Tuple "), F.col("rank").cast("string"), F.lit("======")), F.concat_ws(" ", F.col("lkey").cast("string"), F.col("rkey").cast("string"), F.col("sim").cast("string")), fields("lvalues"), fields("rvalues"), F.lit(""))
    return recommended.select("config", "rank", text.alias("value"))


def write_text_lists(recommended: DataFrame, path: str) -> None:
    """Readable lists, a folder for each configuration; k rows each, so one file each."""
    lines = list_lines(recommended).repartition("config").sortWithinPartitions("config", "rank")
    lines.select("config", "value").write.mode("overwrite").partitionBy("config").text(path)


def read_text_lists(spark: SparkSession, path: str) -> DataFrame:
    """config, rank, lkey, rkey, sim, lvalues, rvalues (the values of a record as one text) of readable lists. Values must not hold line breaks."""
    files = spark.read.text(path, wholetext=True)  # k rows each
    config = F.regexp_extract(F.col("_metadata.file_path"), r"config=([^/]*)/[^/]*$", 1)
    parts = files.select(F.url_decode(config).alias("config"), F.explode(F.split("value", r"(?m)^======Tuple (?=\d+======$)")).alias("part")).where("part <> ''")
    lines = parts.select("config", F.split("part", "\n").alias("x"))
    keys = F.split(F.get("x", 1), " ")
    return lines.select("config", F.regexp_extract(F.get("x", 0), r"^(\d+)======$", 1).cast("int").alias("rank"), F.get(keys, 0).alias("lkey"), F.get(keys, 1).alias("rkey"), F.get(keys, 2).cast("double").alias("sim"), F.get("x", 2).alias("lvalues"), F.get("x", 3).alias("rvalues"))


def write_statistics(statistics: DataFrame, path: str) -> None:
    """A line for each configuration, in one file."""
    statistics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def transposed(statistics: DataFrame, configs: list[str]) -> DataFrame:
    """statistic, and a column for each configuration: a row for each statistic. statistics: (config, numbers)."""
    names = [c for c in statistics.columns if c != "config"]
    long = statistics.select("config", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("config", names, "statistic", "value")
    return long.groupBy("statistic").pivot("config", configs).agg(F.first("value"))


def write_transposed(statistics: DataFrame, fields: list[str], configs: list[str], path: str) -> None:
    """The names of the fields on a line, then a line for each statistic, in the order of its columns, with a value for each configuration."""
    names = [c for c in statistics.columns if c != "config"]
    rows = {r["statistic"]: r for r in transposed(statistics, configs).collect()}  # a row a statistic
    whole = lambda v: "" if v is None else str(int(v)) if float(v).is_integer() else str(v)
    lines = [",".join(fields), *(",".join([n, *(whole(rows[n][c]) for c in configs)]) for n in names)]
    spark = statistics.sparkSession
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def read_transposed(spark: SparkSession, path: str) -> tuple[list[str], dict[str, list[float]]]:
    """Fields, and the values of each statistic by configuration, in the order they were written in."""
    (text,) = (r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    head, *rest = text.removesuffix("\n").split("\n")
    return head.split(","), {x.split(",")[0]: [float(v) if v else None for v in x.split(",")[1:]] for x in rest}
