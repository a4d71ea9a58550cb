"""Model-run log queries; the log rows are derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import runlog as R
from metricloom.plans.registry import load, query, shown

_RAW = """raw AS (SELECT event_id, user_id::VARCHAR AS workflow_run_id, event_type AS task_type,
    'v' || (user_id % 2) AS prompt_version, 'local' AS model, json_extract(props, '$.k')::BIGINT AS k, value FROM events),
    log AS (SELECT *, k % 3 + 1 AS attempt, CASE WHEN k % 4 <> 0 THEN 'validated' WHEN k % 8 <> 0 THEN 'validation_rejected'
      ELSE 'request_failed' END AS status, round(value * 100, 3) AS wall_time_ms, k AS prompt_tokens,
      floor(value * 10)::BIGINT AS completion_tokens, k + floor(value * 10)::BIGINT AS total_tokens,
      round(CASE WHEN value > 0 THEN floor(value * 10) / (value * 1e8 / 1e9) END, 3) AS speed,
      round(k * 1e6 / 1e6, 3) AS load_ms FROM raw)"""


def _log(spark, folder):
    events = load(spark, folder, "events").df
    k = F.get_json_object("props", "$.k").cast("long")
    raw = events.select(
        "event_id",
        F.col("user_id").cast("string").alias("workflow_run_id"),
        F.col("event_type").alias("task_type"),
        F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("prompt_version"),
        F.lit("local").alias("model"),
        (k % 3 + 1).alias("attempt"),
        (k % 4 != 0).alias("validated"),
        (k % 8 != 0).alias("responded"),
        (F.col("value") * 100).alias("wall_time_ms"),
        k.alias("prompt_tokens"),
        F.floor(F.col("value") * 10).alias("completion_tokens"),
        (F.col("value") * 1e8).alias("eval_duration_ns"),
        (k * 1e6).alias("load_duration_ns"),
    )
    return R.derive(raw)


@query(
    "runlog_rows",
    "L1 L2",
    f"""WITH {_RAW} SELECT event_id, status, attempt, prompt_tokens, completion_tokens, total_tokens,
    round(speed, 2) AS completion_tokens_per_second, round(wall_time_ms, 2) AS wall_time_ms,
    round(load_ms, 2) AS ollama_load_duration_ms FROM log""",
)
def runlog_rows(spark, folder):
    out = _log(spark, folder).select(
        "event_id", "status", "attempt", "prompt_tokens", "completion_tokens", "total_tokens",
        "completion_tokens_per_second", "wall_time_ms", "ollama_load_duration_ms",
    )
    return shown(out, 2)


@query(
    "runlog_validation_rates",
    "L3 L4",
    f"""WITH {_RAW} SELECT task_type, prompt_version, model, count(*) AS run_count,
    count(*) FILTER (WHERE status = 'validated') AS validated_count,
    round(count(*) FILTER (WHERE status = 'validated') / count(*), 6) AS validation_rate,
    count(*) FILTER (WHERE attempt = 1) AS first_attempt_count,
    round(count(*) FILTER (WHERE status = 'validated' AND attempt = 1) / nullif(count(*) FILTER (WHERE attempt = 1), 0), 6)
      AS first_attempt_rate FROM log GROUP BY ALL""",
)
def runlog_validation_rates(spark, folder):
    return shown(R.validation_rates(_log(spark, folder)), 6)


@query(
    "runlog_medians",
    "L5",
    f"""WITH {_RAW} SELECT task_type, prompt_version, model, round(median(wall_time_ms), 2) AS median_wall_time_ms,
    median(total_tokens)::DOUBLE AS median_total_tokens, median(completion_tokens)::DOUBLE AS median_completion_tokens
    FROM log GROUP BY ALL""",
)
def runlog_medians(spark, folder):
    return shown(R.medians(_log(spark, folder)), 2)


@query(
    "runlog_retries",
    "L6",
    f"""WITH {_RAW} SELECT workflow_run_id, count(*) FILTER (WHERE attempt > 1) AS retry_count, count(*) AS run_count
    FROM log GROUP BY 1""",
)
def runlog_retries(spark, folder):
    return R.retries(_log(spark, folder))


@query(
    "runlog_cold_warm",
    "L7",
    f"""WITH {_RAW} SELECT task_type, prompt_version, model, CASE WHEN load_ms >= 50 THEN 'cold' ELSE 'warm' END AS start,
    count(*) AS run_count, round(avg(wall_time_ms), 4) AS mean_wall_time_ms FROM log GROUP BY ALL""",
)
def runlog_cold_warm(spark, folder):
    return shown(R.cold_warm(_log(spark, folder), 50.0), 4)
