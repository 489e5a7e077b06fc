"""Structured Streaming: goodput by event-time window, declared windows, held gauges, live caches.

Event time is the intended arrival, so a slow server cannot hide its own delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridia.operators.serving import TPOT_TIMES, TTFT_TIMES


def goodput(requests: DataFrame, *, window: str = "5 minutes", late: str = "10 minutes", base_ttft: float, base_tpot: float, arrival: str = "arrival") -> DataFrame:
    """Counts of each tumbling window; rows later than the watermark are dropped by the engine and counted in its metrics."""
    ok, verdict = F.coalesce(F.col("ok"), F.lit(False)), F.coalesce(F.col("veridical"), F.lit(False))
    timely = ok & (F.col("ttft_s") <= TTFT_TIMES * base_ttft) & (F.col("tpot_s") <= TPOT_TIMES * base_tpot)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    own = requests.withWatermark(arrival, late).groupBy(F.window(arrival, window)).agg(F.count("*").alias("n_issued"), n(ok).alias("n_completed"), n(timely).alias("n_timely"), n(timely & verdict).alias("n_yield"))
    return own.select(F.col("window.start").alias("t_start"), F.col("window.end").alias("t_end"), "n_issued", "n_completed", "n_timely", "n_yield", (F.col("n_timely") / F.col("n_issued")).alias("goodput_frac"), ((F.col("n_timely") - F.col("n_yield")) / F.col("n_issued")).alias("truth_tax_frac"))


def in_declared_windows(samples: DataFrame, windows: DataFrame, *, ts: str = "ts_s", width: float) -> DataFrame:
    """Stream-static join of samples to declared [t_start, t_end), by a bucket of time as wide as the widest window."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spread = windows.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col("t_start")), bucket(F.col("t_end"))))))
    joined = samples.withColumn("_b", bucket(F.col(ts))).join(spread, "_b")
    return joined.filter((F.col(ts) >= F.col("t_start")) & (F.col(ts) < F.col("t_end"))).drop("_b")


HELD = "key string, t_start double, t_end double, n_samples bigint, mean double, events bigint, fell boolean"
_STATE = "first double, last double, gauge double, area double, n bigint, first_count bigint, last_count bigint, fell boolean"


def _hold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Area under the held gauge; a falling counter spoils the window, not its neighbours."""
    first, last, gauge, area, n, first_count, last_count, fell = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, 0, 0, 0, False)
    for frame in frames:
        for ts, value, count in frame.sort_values("ts_s")[["ts_s", "kv_cache_usage", "preemptions_total"]].itertuples(index=False):
            if n == 0:
                first, first_count = ts, count
            else:
                area += (ts - last) * gauge
                fell = fell or count < last_count
            last, gauge, last_count, n = ts, value, count, n + 1
    state.update((float(first), float(last), float(gauge), float(area), int(n), int(first_count), int(last_count), bool(fell)))
    name, start, end = key
    total = area + (end - last) * gauge
    covered = end - first
    yield pd.DataFrame({"key": [name], "t_start": [start], "t_end": [end], "n_samples": [n], "mean": [total / covered if covered > 0 and not fell else None], "events": [last_count - first_count], "fell": [fell]})


def held_gauge(samples: DataFrame) -> DataFrame:
    """Running zero-order-hold mean of every (key, t_start, t_end); samples come in order within a trigger."""
    return samples.groupBy("key", "t_start", "t_end").applyInPandasWithState(_hold, HELD, _STATE, "update", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, key: list[str], *, ts: str, ttl: str) -> DataFrame:
    """One row of each key within the time to live."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def trimmed(requests: DataFrame, start: Column, end: Column, *, arrival: str = "arrival") -> DataFrame:
    """Requests whose intended arrival lies in [start, end)."""
    return requests.filter((F.col(arrival) >= start) & (F.col(arrival) < end))
