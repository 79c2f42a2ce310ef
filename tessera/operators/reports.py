"""Summaries of runs: rates by group, stability over repetitions, keyword overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_runs(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The records of runs: a JSON object or a list of them in each *.json file of a folder. Files whose names
    start with _ or ., such as _summary.json, are hidden from Spark's readers."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json")
    return (reader.schema(schema) if schema else reader).json(folder)


def group_rates(df: DataFrame, by: list[str], rates: dict[str, str], sums: dict[str, str], means: dict[str, str]) -> DataFrame:
    """Count, shares of 0/1 columns, sums and means for each group."""
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.avg(c).alias(n) for n, c in {**rates, **means}.items()]
    out += [F.sum(F.col(c).cast("bigint")).alias(n) for n, c in sums.items()]
    return df.groupBy(*by).agg(*out)


def stability(df: DataFrame, by: list[str], item: list[str], answer: list[str], repeats: int = 2) -> DataFrame:
    """For each group the share of items that got the same answer in all of at least two repetitions."""
    each = df.groupBy(*by, *item).agg(F.min(F.struct(*answer)).alias("a"), F.max(F.struct(*answer)).alias("b"), F.count(F.lit(1)).alias("c"))
    same = (F.col("a") == F.col("b")).cast("int")
    return each.where(F.col("c") >= repeats).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("stable_share"))


#: What a run's answer holds, as JSON text; other members are ignored.
ANSWER = "struct<tables: array<struct<table_name: string, columns: array<struct<column_name: string, semantic_role: string, generator: struct<type: string>, confidence: double>>>>>"
LOW = 0.6  # a confidence below it says that an answer is doubtful


def answers(runs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each column that a run's answer (raw_content, JSON text) names, with the run's columns `keep`. Runs
    that aren't schema_valid, and answers that aren't JSON, have none."""
    parsed = runs.where("schema_valid").select(*keep, F.from_json("raw_content", ANSWER).alias("answer"))
    tables = parsed.select(*keep, F.explode("answer.tables").alias("t"))
    columns = tables.select(*keep, F.col("t.table_name").alias("table"), F.explode("t.columns").alias("c"))
    return columns.select(
        *keep, "table", F.col("c.column_name").alias("column"), F.col("c.semantic_role").alias("semantic_role"), F.col("c.generator.type").alias("generator"), F.col("c.confidence").alias("confidence")
    )


def scored(runs: DataFrame, labels: DataFrame, keep: list[str], stop: list[str], unknown: str = "desconocido") -> DataFrame:
    """The answers that have a label (fixture, table, column, role, acceptable, low_expected), with what is right
    about each: generator_ok, whether the generator is an acceptable one; role_ok, whether the role shares a
    keyword with the label's, null where that is unknown; calibration_ok, whether the confidence is low, null where
    the label doesn't expect that or there is none. keep must hold fixture."""
    made = answers(runs, keep).join(labels, ["fixture", "table", "column"])
    right = F.arrays_overlap(keywords(F.coalesce("role", F.lit("")), stop), keywords(F.coalesce("semantic_role", F.lit("")), stop))
    return made.select(
        *keep, "table", "column", "semantic_role", "generator", "confidence",
        F.coalesce(F.array_contains("acceptable", F.col("generator")), F.lit(False)).alias("generator_ok"),
        F.when(F.coalesce("role", F.lit("")) != unknown, F.coalesce(right, F.lit(False))).alias("role_ok"),
        F.when(F.col("low_expected"), F.col("confidence") < LOW).alias("calibration_ok"),
    )


def score_rates(runs: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """For each group its runs, the valid ones among them, their mean latency, and hits and totals of each score;
    a score that is null counts in neither."""
    calls = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if("schema_valid").alias("valid"), F.avg("latency").alias("latency"))
    sums = [x for name in ("generator", "role", "calibration") for x in (F.count_if(f"{name}_ok").alias(f"{name}_hits"), F.count(f"{name}_ok").alias(f"{name}_total"))]
    return calls.join(found.groupBy(*by).agg(*sums), by, "left").na.fill(0, [f"{n}_{x}" for n in ("generator", "role", "calibration") for x in ("hits", "total")])


def keywords(text: Column, stop: list[str]) -> Column:
    words = F.filter(F.split(F.lower(text), "[^a-záéíóúñ0-9]+"), lambda w: w != "")
    return F.array_except(words, F.array(*map(F.lit, stop)))
