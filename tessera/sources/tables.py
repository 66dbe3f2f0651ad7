"""Readers, writers, keyed upserts and published versions; SQL over named tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

from tessera.sources.scratch import settled


#: Lines that a schema is inferred from where none is given.
INFER_LINES = 1000


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Rows of CSV files with a header. Without a schema the first INFER_LINES lines give it; what doesn't fit it further on is null."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", encoding)
    if schema is None:
        lines = [x["value"] for x in spark.read.text(path).limit(INFER_LINES).collect()]
        schema = spark.read.option("header", True).option("inferSchema", True).csv(spark.sparkContext.parallelize(lines, 1)).schema
    return reader.schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


BAD = "_bad_record"


def _checked(reader: DataFrameReader, form: str, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = settled(reader.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).format(form).load(path))
    return parsed.where(F.col(BAD).isNull()).drop(BAD), parsed.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("record"))


def read_csv_checked(spark: SparkSession, path: str, schema: str, header: bool = True, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, records that don't as they stand in the file). The input is parsed once and written to the scratch folder."""
    return _checked(spark.read.option("header", header).option("encoding", encoding), "csv", path, schema)


def read_json_checked(spark: SparkSession, path: str, schema: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records that fit the schema, those that don't as they stand in the file); one record a line, or whole files."""
    return _checked(spark.read.option("multiLine", not lines), "json", path, schema)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested fields as columns named by their path; lists and maps as JSON text."""

    def leaves(schema: StructType, at: tuple[str, ...] = ()):
        for f in schema.fields:
            path = (*at, f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, path)
            else:
                c = F.col(".".join(f"`{p}`" for p in path))
                yield (F.to_json(c) if isinstance(f.dataType, ArrayType | MapType) else c).alias(separator.join(path))

    return df.select(*leaves(df.schema))


def parse_text_rows(df: DataFrame, text: str, schema: str) -> DataFrame:
    """A column of JSON or CSV records as a struct ``record``; JSON is tried first, neither gives null."""
    first = F.get(F.split(F.trim(F.col(text)), ""), F.lit(0))
    parsed = F.when(first == "{", F.from_json(text, schema)).otherwise(F.from_csv(F.col(text), schema))
    return df.withColumn("record", parsed)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, position, block: blocks between blank lines of whole text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\n{2,}")).alias("position", "block"))
    return rows.select("path", "position", F.trim("block").alias("block")).where("block != ''")


def list_files(spark: SparkSession, path: str, pattern: str = "*", most: int = 50 << 20) -> DataFrame:
    """path, length, modificationTime, reject_reason of the files below a folder; contents are not read. Spark lists no empty files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return rows.withColumn("reject_reason", F.when(F.col("length") <= 0, "empty").when(F.col("length") > most, "too large"))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row of each key; of equal times the change wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_new")


def delete(current: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(gone, list(keys), "left_anti")


def publish(df: DataFrame, root: str, version: str, key: str, **about: object) -> None:
    """A new version folder, its manifest, and last the pointer that readers follow; all through Spark's file system."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    seen = spark.read.parquet(f"{root}/version={version}").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids")).first()
    manifest = json.dumps({"version": version, "count": seen["n"], "ids": seen["ids"], **about})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_manifest/{version}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_current")


def read_published(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/_current").first()["value"]
    return spark.read.parquet(f"{root}/version={version}")


def consistency(spark: SparkSession, root: str, key: str) -> DataFrame:
    """One row: manifest count, table count, distinct ids, consistent."""
    version = spark.read.text(f"{root}/_current").first()["value"]
    told = spark.read.json(f"{root}/_manifest/{version}").select(F.col("count").alias("manifest_count"))
    seen = read_published(spark, root).agg(F.count(F.lit(1)).alias("table_count"), F.count_distinct(key).alias("ids"))
    return told.join(seen).withColumn("consistent", (F.col("manifest_count") == F.col("table_count")) & (F.col("table_count") == F.col("ids")))


def drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys that only one side has, and whether there are more than two of them."""
    both = a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full_outer")
    one = both.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))
    return one.withColumn("drifted", F.col("only_first") + F.col("only_second") > 2)


def append_log(df: DataFrame, path: str, cut: Mapping[str, int], hashed: Mapping[str, str] | None = None) -> None:
    """Append rows, long texts cut to the given lengths; ``hashed`` names a column for the SHA-256 of each whole text before it is cut."""
    sums = {name: F.sha2(F.col(c).cast("string"), 256) for c, name in (hashed or {}).items()}
    df.withColumns(sums).withColumns({c: F.substring(c, 1, n) for c, n in cut.items()}).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def sql_report(spark: SparkSession, query: str, tables: Mapping[str, DataFrame], first: int = 10) -> DataFrame:
    """section, name, statistic, value, text of a query's result: its number of rows, its first rows as JSON, statistics of each column."""
    from tessera.operators.profiling import describe

    found = run_sql(spark, query, tables)
    result = settled(found)
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    out = result.agg(F.lit("rows").alias("section"), none.alias("name"), none.alias("statistic"), F.count(F.lit(1)).cast("double").alias("value"), none.alias("text"))
    some = found.limit(first).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in found.columns])).alias("text"), (F.monotonically_increasing_id() + 1).cast("string").alias("name"))
    out = out.unionByName(some.select(F.lit("preview").alias("section"), "name", none.alias("statistic"), number.alias("value"), "text"))
    stats = describe(result)
    each = [F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value"), none.alias("text")) for c in stats.columns if c not in ("column_name", "top")]
    each.append(F.struct(F.lit("top").alias("statistic"), number.alias("value"), F.col("top").cast("string").alias("text")))
    stats = stats.select(F.col("column_name").alias("name"), F.inline(F.array(*each))).where("value is not null or text is not null")
    return out.unionByName(stats.select(F.lit("statistics").alias("section"), "name", "statistic", "value", "text"))


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, columns, row_count, missing, summary of each table: one aggregate each."""
    out = None
    for name, df in tables.items():
        nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
        one = df.agg(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), F.count(F.lit(1)).alias("row_count"), nulls.alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("summary", F.format_string("%s has %d rows and %d columns", "table_name", "row_count", "columns"))


def where_equal(df: DataFrame, wanted: Mapping[str, object], exact: bool = True) -> DataFrame:
    """Rows whose columns equal all given values, as they are or as text without regard to case."""
    for c, v in wanted.items():
        df = df.where(F.col(c) == F.lit(v)) if exact else df.where(F.lower(F.col(c).cast("string")) == str(v).lower())
    return df


def table_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, position, column_name, type, row_count of every column: one count per table."""
    out = None
    for name, df in tables.items():
        about = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema.fields)]
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.inline(F.array(*about)))
        out = one if out is None else out.unionByName(one)
    return out


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows in an order that is given, so that they are the same each time."""
    return df.orderBy(*order).limit(n)


def list_documents(df: DataFrame, category: str | None = None, column: str = "category") -> DataFrame:
    return df if category is None else df.where(F.col(column) == category)
