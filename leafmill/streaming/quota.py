"""The two quotas of the answer service: so many answers a day in all, and so many for each visitor.

A request is refused for the day before it is refused for its visitor; refused ones count for nothing; keys are UTC days.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from leafmill.session import cut, small_or_shuffled

PER_DAY, PER_VISITOR, TTL_HOURS, LATE = 15, 3, 48, "14 days"
DECISION = "request_id bigint, day string, visitor string, at timestamp, decision string"


def decide(requests: DataFrame, per_day: int = PER_DAY, per_visitor: int = PER_VISITOR) -> DataFrame:
    """Requests (request_id, day, visitor, at), each id once, with their decision: allowed, day-cap or visitor-cap. Exact: a
    visitor's first requests are eligible, and the day's cap falls after so many eligible ones. Days are independent.

    Only first ones are ever ranked: before they are shuffled, each task drops all but the first of its visitor, or day, so
    neither a busy visitor nor a busy day is a hot group.
    """
    order = ["at", "request_id"]

    def first(rows: DataFrame, key: list[str], n: int) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("nth") <= n).drop("nth")

    key = ["request_id", "day", "visitor", "at"]
    eligible = first(requests.select(*key), ["day", "visitor"], per_visitor)
    last = F.max(F.struct(*order)).alias("last")
    full = first(eligible, ["day"], per_day).groupBy("day").agg(last, F.count("*").alias("n")).filter(F.col("n") >= per_day).select("day", "last")
    full = small_or_shuffled(cut(full))
    r = requests.join(eligible.select("request_id", F.lit(True).alias("eligible")), "request_id", "left").join(full, "day", "left")
    late = F.lit(per_day <= 0) | F.coalesce(F.struct(*order) > F.col("last"), F.lit(False))
    decision = F.when(late, "day-cap").when(F.col("eligible"), "allowed").otherwise("visitor-cap")
    return r.withColumn("decision", decision).select(*requests.columns, "decision")


def decide_stream(requests: DataFrame, per_day: int = PER_DAY, per_visitor: int = PER_VISITOR, late: str = LATE) -> DataFrame:
    """The same over a stream, in order of arrival: the state of a day is its count and its visitors' counts, and goes 48
    hours after the day's last request once nothing later than ``late`` is expected any more. One key for each day makes
    the day's cap exact."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, visitors = (lambda s: (s[0], json.loads(s[1])))(state.get) if state.exists else (0, {})
        rows = pd.concat(list(parts)).sort_values(["at", "request_id"], kind="stable")
        out = []
        for v in rows["visitor"]:
            if total >= per_day:
                out.append("day-cap")
            elif visitors.get(v, 0) >= per_visitor:
                out.append("visitor-cap")
            else:
                total, visitors[v] = total + 1, visitors.get(v, 0) + 1
                out.append("allowed")
        state.update((total, json.dumps(visitors)))
        last = int(rows["at"].max().timestamp() * 1000) + TTL_HOURS * 3_600_000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(decision=out, day=key[0])[["request_id", "day", "visitor", "at", "decision"]]

    return requests.withWatermark("at", late).groupBy("day").applyInPandasWithState(step, DECISION, "total bigint, visitors string", "append", "EventTimeTimeout")
