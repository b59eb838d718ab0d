"""Files: JSON lines, JSON arrays, Markdown tables, reports; idempotent appends and keyed caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, mode: str = "strict", tag_files: bool = False) -> DataFrame:
    """JSON lines. strict: a bad line fails; drop: bad lines are left out; lenient: also no file means no rows."""
    options = {"strict": "FAILFAST", "drop": "DROPMALFORMED", "lenient": "DROPMALFORMED"}
    paths = [path] if isinstance(path, str) else list(path)
    try:
        df = spark.read.schema(schema).option("mode", options[mode]).json(paths)
    except AnalysisException:
        if mode != "lenient":
            raise
        df = spark.createDataFrame([], schema)
        return df.withColumn("file", F.lit(None).cast("string")) if tag_files else df
    return df.withColumn("file", F.col("_metadata.file_path")) if tag_files else df


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """The catalog's own file, whose column names are [table, name] pairs and whose keys may be nested."""
    raw = read_json_array(spark, path, "db_id STRING, table_names_original ARRAY<STRING>, column_names_original ARRAY<ARRAY<STRING>>, column_types ARRAY<STRING>, "
                                       "primary_keys ARRAY<STRING>, foreign_keys ARRAY<ARRAY<INT>>")
    single = F.flatten(F.transform("primary_keys", lambda k: F.when(k.startswith("["), F.from_json(k, "array<int>")).otherwise(F.array(k.try_cast("int")))))
    pairs = F.transform("column_names_original", lambda c: F.struct(F.get(c, F.lit(0)).try_cast("int").alias("tbl"), F.get(c, F.lit(1)).alias("name")))
    return raw.withColumns({"column_names_original": pairs, "primary_keys": single})


def samples(df: DataFrame) -> DataFrame:
    """question, query, db_id with '' and tokens with nothing for what is missing."""
    tokens = F.col("tokens") if "tokens" in df.columns else F.lit(None).cast("array<string>")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("question", "query", "db_id")], F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))


def read_jsonl_head(spark: SparkSession, path: str, schema: str, rows: int) -> DataFrame:
    """The first rows of a JSON lines file, in its order; a limit that is the feature. No more of the file is read than they need."""
    text = spark.read.text(path).filter("trim(value) <> ''").limit(rows)  # a plain limit takes the first partitions first
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells): the rows of the Markdown tables of a file, without rulers."""
    text = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^\s*\|[\s|:-]+$"))
    inner = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    return text.select(F.col("value").alias("line"), F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_arrays(df: DataFrame, path: str, key: str, parts: int) -> None:
    """JSON arrays in ``parts`` folders by key, for tables like a catalog: an array is one value and read by one task."""
    made = df.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    made.write.mode("overwrite").partitionBy("part").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(metrics: DataFrame, details: DataFrame, path: str) -> None:
    """Metrics of one row and any number of details, each as JSON lines below ``path``."""
    write_jsonl(metrics.coalesce(1), f"{path}/metrics")
    write_jsonl(details, f"{path}/details")


def read_report(spark: SparkSession, path: str, metrics: str, details: str) -> tuple[DataFrame, DataFrame]:
    return read_jsonl(spark, f"{path}/metrics", metrics), read_jsonl(spark, f"{path}/details", details)


def write_folds(df: DataFrame, path: str, fold: str = "fold", split: str = "split") -> None:
    """A folder for each fold and split, and how many rows each has in ``metadata``."""
    df.write.mode("overwrite").partitionBy(fold, split).parquet(f"{path}/rows")
    df.groupBy(fold, split).agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def append_missing(df: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Append the rows whose key the table at ``path`` lacks; running it again adds nothing. Returns what was new."""
    fresh = df.dropDuplicates(list(key))
    try:
        there = df.sparkSession.read.parquet(path).select(*key).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        fresh = fresh.join(there, list(key), "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def latest(df: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """An append-only cache read back: the last entry of every key."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.col(at)).alias("x")
    return df.groupBy(*key).agg(last).select(*key, *[F.col(f"x.{c}") for c in rest])


def markdown(sections: Sequence[tuple[str, DataFrame]], rows: int = 1000) -> str:
    """A report of small tables; numbers with three decimals. Tables beyond ``rows`` rows are cut, and say so."""
    out: list[str] = []
    shown = lambda v: "N/A" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    for title, df in sections:
        taken = df.limit(rows + 1).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(shown(v) for v in row) + " |" for row in taken[:rows]]
        out += [f"(the first {rows} rows)"] * (len(taken) > rows) + [""]
    return "\n".join(out)
