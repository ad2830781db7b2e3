"""Requests in batches: plans, sizes, costs, completeness and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S

FALLBACK_MODEL = "gpt-5-nano"


def prices(spark: SparkSession) -> DataFrame:
    """model, input, cached_input, output in USD for 10^6 tokens; null where there is no price."""
    return spark.createDataFrame([(model, *usd) for model, usd in fixed.PRICES.items()], "model string, input double, cached_input double, output double")


def costs(usage: DataFrame, discount: float = 0.0) -> DataFrame:
    """usage (model, input_tokens, output_tokens, cached_tokens) with input_cost, output_cost, cached_cost, total_cost.

    An unknown model costs what the fallback model does.
    """
    table = prices(usage.sparkSession)
    known = usage.join(F.broadcast(table.select("model").withColumn("known", F.lit(True))), "model", "left").withColumn("priced_as", F.when(F.col("known"), F.col("model")).otherwise(FALLBACK_MODEL)).drop("known")
    rows = known.join(F.broadcast(table.withColumnRenamed("model", "priced_as")), "priced_as").withColumns(
        {"input_cost": S.cost(F.col("input_tokens"), F.col("input"), discount), "output_cost": S.cost(F.col("output_tokens"), F.col("output"), discount), "cached_cost": S.cost(F.col("cached_tokens"), F.col("cached_input"), discount)}
    )
    return rows.withColumn("total_cost", F.col("input_cost") + F.col("output_cost") + F.col("cached_cost")).drop("priced_as", "input", "cached_input", "output")


def symbol_plan(n: Column) -> tuple[Column, Column]:
    """Input and output tokens expected for n symbols, one request each."""
    return 650 * n, 350 * n


def batch_plan(n: Column, size: int) -> tuple[Column, Column, Column]:
    """Batches, input and output tokens expected for n symbols in batches of `size`."""
    batches = F.ceil(n / size)
    return batches, batches * (400 + size * 550), batches * size * 400


def numbered_batches(rows: DataFrame, size: int, order: str, within: list[str] | None = None) -> DataFrame:
    """rows with batch: consecutive runs of `size` by order, within groups if given."""
    w = Window.partitionBy(*(within or [])).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def batch_texts(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """One text per batch, its rows in order with a line between them."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n---\n").alias("batch_text"), F.count("*").alias("n"))


def missing(requests: DataFrame, responses: DataFrame, key: str = "symbol_id") -> DataFrame:
    """Requested keys without a response."""
    return requests.join(responses.select(key).distinct(), key, "left_anti")


def retry_set(requests: DataFrame, absent: DataFrame, key: str = "symbol_id") -> DataFrame:
    """Requests whose key is absent, with their texts cut for another try."""
    return requests.join(absent.select(key).distinct(), key, "left_semi").withColumn("text", S.retry_truncated(F.col("text")))


def matched(requests: DataFrame, responses: DataFrame, key: str = "symbol_id", order: str = "seq") -> DataFrame:
    """Each request with its last response by order, success false where there is none."""
    last = responses.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rn = 1").drop("rn", order)
    return requests.join(last.withColumn("success", F.lit(True)), key, "left").withColumn("success", F.coalesce("success", F.lit(False)))


def token_classes(rows: DataFrame, text: str = "text") -> DataFrame:
    """size_class, n, total_tokens of the texts."""
    n = S.tokens(F.col(text))
    return rows.select(n.alias("t")).groupBy(S.size_class(F.col("t")).alias("size_class")).agg(F.count("*").alias("n"), F.sum("t").alias("total_tokens"))


def budget_window(usage: DataFrame, by: str, seconds: int = 60) -> DataFrame:
    """usage (ts, tokens, by) with used: tokens of the last `seconds`, own ones included, per group."""
    w = Window.partitionBy(by).orderBy("us").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return usage.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("used", F.sum("tokens").over(w)).drop("us")
