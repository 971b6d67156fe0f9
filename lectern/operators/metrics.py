"""Run metrics: rates, latencies and percentiles by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.sources.tables import table


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs from events: the event type stands for the model, errors for failed runs, the value for milliseconds."""
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(4))).alias("model_id"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("total_ms"), F.pmod("event_id", F.lit(7)).alias("tokens"))


def run_aggregates(rows: DataFrame) -> DataFrame:
    """Success rate over all runs, latency of the successful ones; percentiles by linear interpolation."""
    ok = lambda c: F.when(F.col("success"), c)
    return rows.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.col("success").cast("long")).alias("successes"), F.round(F.avg(F.col("success").cast("double")), 4).alias("success_rate"),
        F.round(F.sum(ok(F.round(F.col("total_ms") * 100).cast("long"))) / F.sum(F.col("success").cast("long")) / 100, 4).alias("mean_ms"),
        F.round(F.percentile(ok(F.col("total_ms")), 0.5), 4).alias("p50_ms"), F.round(F.percentile(ok(F.col("total_ms")), 0.95), 4).alias("p95_ms"),
    )


def token_rate(calls: DataFrame) -> DataFrame:
    """All tokens over the seconds that they took at each call's own rate; calls without a rate or tokens don't count."""
    done = calls.where("tokens > 0 AND rate > 0")
    return done.groupBy("model_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.round(F.col("tokens") / F.col("rate") * 1_000_000).cast("long")).alias("micros")).select("model_id", "tokens", F.round(F.col("tokens") * 1_000_000 / F.col("micros"), 4).alias("tokens_per_second"))


def input_drift(rows: DataFrame) -> DataFrame:
    """An order-free digest of each model's run ids (count, sums and exclusive or of their hashes); unequal digests mean unequal inputs."""
    h = F.conv(F.substring(F.sha2(F.col("run_id").cast("string"), 256), 1, 12), 16, 10).cast("long")
    return rows.select("model_id", h.alias("h")).groupBy("model_id").agg(F.count(F.lit(1)).alias("inputs"), F.sum(F.col("h") % 1_000_003).alias("sum_a"), F.sum(F.col("h") % 998_244_353).alias("sum_b"), F.bit_xor("h").alias("mix"))


def comparison(configured: DataFrame, measured: DataFrame) -> DataFrame:
    """Every configured model, with its figures where there are any."""
    return configured.join(measured, "model_id", "left").select("model_id", F.coalesce("runs", F.lit(0)).alias("runs"), "success_rate", "p50_ms", F.when(F.col("runs").isNull(), "not measured").otherwise("measured").alias("state"))


def stage_rollup(rows: DataFrame) -> DataFrame:
    """Calls, failed calls (retries) and time by run group and stage."""
    return rows.groupBy("model_id", "stage").agg(F.count(F.lit(1)).alias("calls"), F.sum((~F.col("success")).cast("long")).alias("retries"), F.sum(F.round(F.col("total_ms") * 100).cast("long")).alias("hundredths"))


def timing_sums(lines: DataFrame) -> DataFrame:
    """Timing lines `stage=... ms=...` to fields, summed by stage and kind; lines without both fields are left out."""
    stage, ms = F.regexp_extract("line", r"stage=(\S+)", 1), F.regexp_extract("line", r"\bms=(\d+)", 1)
    return lines.select(stage.alias("stage"), ms.alias("ms")).where("stage <> '' AND ms <> ''").groupBy("stage").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("ms").cast("long")).alias("ms"))


def validation_log(events: DataFrame) -> DataFrame:
    """Validation events of an owner and run, numbered oldest first."""
    order = W.partitionBy("owner_id", "run").orderBy("at", "event_id")
    return events.select("owner_id", "run", "event_id", F.row_number().over(order).cast("long").alias("position"))


def _comparison(s: SparkSession, d: str) -> DataFrame:
    configured = table(s, d, "events").select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(6))).alias("model_id")).distinct()
    return comparison(configured, run_aggregates(runs(s, d)))


def _stages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(4))).alias("model_id"), F.col("event_type").alias("stage"), (F.col("value") >= 10).alias("success"), F.col("value").alias("total_ms"))


def _timing(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("perf stage="), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" ms="), F.floor(F.abs("value")).cast("string"))
    return timing_sums(table(s, d, "events").select(line.alias("line")))


RUNS_SQL = "runs AS (SELECT event_id AS run_id, concat('m', user_id % 4) AS model_id, event_type <> 'error' AS success, value AS total_ms, event_id % 7 AS tokens FROM events)"
QUERIES = {"run_aggregates": lambda s, d: run_aggregates(runs(s, d)), "token_rate": lambda s, d: token_rate(runs(s, d).withColumn("rate", F.round(F.abs("total_ms"), 2))), "input_drift": lambda s, d: input_drift(runs(s, d)),
    "model_comparison": _comparison, "stage_rollup": lambda s, d: stage_rollup(_stages(s, d)), "timing_sums": _timing,
    "validation_log": lambda s, d: validation_log(table(s, d, "events").select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("run"), "event_id", F.col("ts").alias("at")))}
ORACLES = {
    "run_aggregates": f"""WITH {RUNS_SQL} SELECT model_id, count(*) AS runs, count(*) FILTER (success) AS successes, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 4) AS success_rate,
      round(CAST(sum(CAST(round(total_ms * 100) AS BIGINT)) FILTER (success) AS DOUBLE) / count(*) FILTER (success) / 100, 4) AS mean_ms, round(quantile_cont(total_ms, 0.5) FILTER (success), 4) AS p50_ms, round(quantile_cont(total_ms, 0.95) FILTER (success), 4) AS p95_ms FROM runs GROUP BY 1""",
    "token_rate": f"WITH {RUNS_SQL}, c AS (SELECT *, round(abs(total_ms), 2) AS rate FROM runs) SELECT model_id, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(tokens) AS DOUBLE) * 1000000 / CAST(sum(CAST(round(tokens / rate * 1000000) AS BIGINT)) AS DOUBLE), 4) AS tokens_per_second FROM c WHERE tokens > 0 AND rate > 0 GROUP BY 1",
    "input_drift": f"WITH {RUNS_SQL}, h AS (SELECT model_id, CAST('0x' || sha256(CAST(run_id AS VARCHAR))[1:12] AS BIGINT) AS h FROM runs) SELECT model_id, count(*) AS inputs, CAST(sum(h % 1000003) AS BIGINT) AS sum_a, CAST(sum(h % 998244353) AS BIGINT) AS sum_b, bit_xor(h) AS mix FROM h GROUP BY 1",
    "stage_rollup": "SELECT concat('m', user_id % 4) AS model_id, event_type AS stage, count(*) AS calls, CAST(sum(CASE WHEN value >= 10 THEN 0 ELSE 1 END) AS BIGINT) AS retries, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM events GROUP BY 1, 2",
    "timing_sums": "SELECT event_type AS stage, count(*) AS lines, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY 1",
    "validation_log": "SELECT user_id AS owner_id, event_type AS run, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS position FROM events",
}
ORACLES["model_comparison"] = f"""WITH a AS ({ORACLES['run_aggregates']}), c AS (SELECT DISTINCT concat('m', user_id % 6) AS model_id FROM events)
  SELECT model_id, coalesce(runs, 0) AS runs, success_rate, p50_ms, CASE WHEN runs IS NULL THEN 'not measured' ELSE 'measured' END AS state FROM c LEFT JOIN a USING (model_id)"""
