"""Model-run log: schema, row derivations and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.quantiles import exact_quantiles

# Fields of a log row, in file order.
SCHEMA = (
    "schema_version int, run_id string, workflow_run_id string, started_at_utc timestamp, "
    "task_type string, prompt_version string, dataset_id string, report_id string, "
    "story_id string, attempt int, model string, status string, wall_time_ms double, "
    "prompt_tokens long, completion_tokens long, total_tokens long, "
    "completion_tokens_per_second double, ollama_total_duration_ms double, "
    "ollama_load_duration_ms double, ollama_prompt_eval_duration_ms double, "
    "ollama_eval_duration_ms double, message_count int, prompt_characters long, "
    "response_characters long, temperature double, num_ctx int, num_predict int, "
    "error_type string"
)
GROUP = ("task_type", "prompt_version", "model")


def _nonnegative(c: Column) -> Column:
    return F.when(c >= 0, c)


def derive(raw: DataFrame) -> DataFrame:
    """Derived log fields from raw counters.

    ``raw`` has ``prompt_tokens``, ``completion_tokens``, ``*_duration_ns``,
    ``validated`` and ``responded`` beside the identity fields.
    """
    prompt = _nonnegative(F.col("prompt_tokens"))
    completion = _nonnegative(F.col("completion_tokens"))
    seconds = _nonnegative(F.col("eval_duration_ns")) / 1e9
    speed = F.when(seconds > 0, F.try_divide(completion.cast("double"), seconds))
    status = (
        F.when(F.col("validated"), "validated")
        .when(F.col("responded"), "validation_rejected")
        .otherwise("request_failed")
    )
    out = raw.withColumns(
        {
            "status": status,
            "prompt_tokens": prompt,
            "completion_tokens": completion,
            "total_tokens": prompt + completion,
            "completion_tokens_per_second": F.round(speed, 3),
            "wall_time_ms": F.round("wall_time_ms", 3),
        }
    )
    for name in ("total", "load", "prompt_eval", "eval"):
        column = f"{name}_duration_ns"
        if column in raw.columns:
            value = F.round(_nonnegative(F.col(column)) / 1e6, 3)
            out = out.withColumn(f"ollama_{name}_duration_ms", value)
    return out


def validation_rates(log: DataFrame) -> DataFrame:
    ok = F.col("status") == "validated"
    first = F.col("attempt") == 1
    return log.groupBy(*GROUP).agg(
        F.count("*").alias("run_count"),
        F.count_if(ok).alias("validated_count"),
        F.try_divide(F.count_if(ok), F.count("*")).alias("validation_rate"),
        F.count_if(first).alias("first_attempt_count"),
        F.try_divide(F.count_if(ok & first), F.count_if(first)).alias("first_attempt_rate"),
    )


def medians(log: DataFrame) -> DataFrame:
    """Median wall time, total and completion tokens per task, prompt version and model."""
    names = ("wall_time_ms", "total_tokens", "completion_tokens")
    measures = F.array(
        *[
            F.struct(F.lit(n).alias("_field"), F.col(n).cast("double").alias("_value"))
            for n in names
        ]
    )
    long = log.select(*GROUP, F.inline(measures))
    middle = exact_quantiles(long, [*GROUP, "_field"], F.col("_value"), [0.5])
    return middle.groupBy(*GROUP).agg(
        *[
            F.max(F.when(F.col("_field") == n, F.col("quantiles")[0])).alias(f"median_{n}")
            for n in names
        ]
    )


def retries(log: DataFrame) -> DataFrame:
    return log.groupBy("workflow_run_id").agg(
        F.count_if(F.col("attempt") > 1).alias("retry_count"), F.count("*").alias("run_count")
    )


def cold_warm(log: DataFrame, threshold_ms: float) -> DataFrame:
    """Runs split by load time, with run counts and mean wall time."""
    cold = F.coalesce(F.col("ollama_load_duration_ms") >= threshold_ms, F.lit(False))
    return log.groupBy(*GROUP, F.when(cold, "cold").otherwise("warm").alias("start")).agg(
        F.count("*").alias("run_count"), F.avg("wall_time_ms").alias("mean_wall_time_ms")
    )
