"""Request-log analytics: calls(caller, call_id, ts, status_code, duration_s, waited_s)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.scale import running, sliced


def _micros(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _is_error():
    return F.col("status_code") >= 400


def call_log_stats(calls: DataFrame) -> DataFrame:
    """Totals, errors, blocked calls, error rate and mean duration of successes per caller."""
    error = _is_error()
    rows = calls.groupBy("caller").agg(
        F.count("*").alias("total_requests"), F.count_if(error).alias("total_errors"),
        F.count_if(F.col("waited_s") > 0).alias("blocked_requests"),
        F.avg(F.when(~error, F.col("duration_s"))).alias("mean"))
    rate = F.col("total_errors") / F.greatest(F.lit(1), F.col("total_requests")) * 100
    return rows.select("caller", "total_requests", "total_errors", "blocked_requests",
                       F.round(rate, 2).alias("error_rate_percent"),
                       F.round(F.coalesce("mean", F.lit(0.0)), 2).alias("avg_success_seconds"))


def error_class(status):
    return F.when(status == 429, "rate_limit").when(status.isin(fv.SERVER_ERRORS), "server_error").otherwise("other")


def errors_by_class(calls: DataFrame) -> DataFrame:
    return (calls.filter(_is_error()).groupBy("caller", error_class(F.col("status_code")).alias("error_class"))
            .agg(F.count("*").alias("n_errors")))


def sliding_requests(calls: DataFrame, window_seconds: int = fv.REQUEST_WINDOW_SECONDS,
                     limit: int = fv.REQUESTS_PER_MINUTE, slices: int | None = None) -> DataFrame:
    """Per request: how many earlier requests of the caller are at most ``window_seconds`` old, and whether it may go.

    Each request counts +1 when made and -1 once its age passes the window; the count is a running sum over those
    events.  It therefore splits anywhere, also inside one caller's busiest minute.
    """
    micros = _micros("ts")
    event = F.struct(F.lit(1).alias("change"), micros.alias("at")), F.struct(
        F.lit(-1).alias("change"), (micros + window_seconds * 1_000_000).alias("at"))
    events = (calls.select("caller", "call_id", F.explode(F.array(*event)).alias("event"))
              .select("caller", "call_id", "event.change", "event.at"))
    # At equal times requests come before expiries: a request exactly as old as the window still counts.
    order = [F.asc("at"), F.desc("change"), F.asc("call_id")]
    counted = running(sliced(events, ["caller"], order, slices), ["caller"], order,
                      {"open": ("sum", F.col("change"))})
    return (counted.filter("change = 1")
            .select("caller", "call_id", F.timestamp_micros("at").alias("ts"),
                    (F.col("open") - 1).alias("recent_requests"), (F.col("open") - 1 < limit).alias("allowed")))


def error_streak(calls: DataFrame, slices: int | None = None) -> DataFrame:
    """Per request: errors of the caller since its last success, this request included."""
    order = [F.asc("ts"), F.asc("call_id")]
    rows = calls.select("caller", "call_id", "ts", _is_error().cast("bigint").alias("is_error"))
    cut = sliced(rows, ["caller"], order, slices)
    counted = running(cut, ["caller"], order, {"errors": ("sum", F.col("is_error"))})
    # Errors only grow, so their count at the last success is the largest count at any success so far.
    marked = running(counted, ["caller"], order,
                     {"settled": ("max", F.when(F.col("is_error") == 0, F.col("errors")))})
    return marked.select("caller", "call_id", "ts", "is_error",
                         (F.col("errors") - F.coalesce("settled", F.lit(0))).alias("consecutive_errors"))


def recent_errors(calls: DataFrame, as_of: str | None = None, horizon_seconds: int = fv.RECENT_ERROR_SECONDS,
                  kept: int = fv.RECENT_ERROR_KEPT) -> DataFrame:
    """Per caller: errors younger than the horizon among the latest few.

    ``as_of`` is a timestamp; without it each caller's latest request is the present.  Spark limits each map task to
    the latest ``kept`` errors per caller before the shuffle.
    """
    latest = Window.partitionBy("caller").orderBy(F.desc("ts"), F.desc("call_id"))
    errors = (calls.filter(_is_error()).select("caller", "call_id", "ts")
              .withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= kept))
    now = calls.groupBy("caller").agg(F.max("ts").alias("last_ts"))
    present = F.unix_micros(F.lit(as_of).cast("timestamp")) if as_of else _micros("last_ts")
    recent = present - _micros("ts") < horizon_seconds * 1_000_000
    return (now.join(errors, "caller", "left").groupBy("caller")
            .agg(F.count_if(F.col("ts").isNotNull() & recent).alias("recent_errors"),
                 F.count("ts").alias("kept_errors")))
