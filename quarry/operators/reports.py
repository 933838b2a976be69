"""Reports over runs: latencies by component, matches of expected and shown nudges, deliveries, rooms."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.folds import in_order


def latency_table(rows: DataFrame, component: str, value: str) -> DataFrame:
    """n, p50, p95 and max by component; see ranks.at_places."""
    found = ranks.at_places(rows, [component], value, {"p50": ranks.nearest(0.5), "p95": ranks.nearest(0.95)})
    return found.select(component, "n", F.round("p50", 1).alias("p50"), F.round("p95", 1).alias("p95"), F.col("most").alias("max"))


def by_run(rows: DataFrame, run: str, value: str) -> DataFrame:
    """n and percentiles of each run's own values."""
    return latency_table(rows, run, value).drop("max")


def histogram(decisions: DataFrame) -> DataFrame:
    """How often each reason held a nudge back."""
    return decisions.where("decision = 'suppressed'").groupBy("reason").agg(F.count("*").alias("n"))


def recent_percentiles(events: DataFrame, value: str, most: int = 500) -> DataFrame:
    """n, p50 and p95 of each room's last values, as a display rounds them: the place is floored."""
    last = newest(events.where(F.col(value).isNotNull()), most)
    found = ranks.at_places(last, ["room"], value, {"p50": ranks.floored(0.5), "p95": ranks.floored(0.95)})
    return found.select("room", "n", F.bround("p50", 0).cast("long").alias("p50"), F.bround("p95", 0).cast("long").alias("p95"))


def path_ratios(turns: DataFrame) -> DataFrame:
    """How many turns were answered without a model (quick), by a ready line (fast), both, and how many model calls that spared."""
    both = F.col("quick") & F.col("fast")
    counts = turns.agg(F.count("*").alias("turns"), F.count_if("quick").alias("quick"), F.count_if("fast").alias("fast"), F.count_if(both).alias("both"))
    return counts.select("*", (F.col("quick") + F.col("fast")).alias("avoided"), F.round(F.try_divide(F.col("quick") + F.col("fast"), 2 * F.col("turns")), 6).alias("share"))


def deliveries(shown: DataFrame, displayed: DataFrame, received: DataFrame) -> DataFrame:
    """Rows (room, id, at) with when each arrived: on a display if one acknowledged it, else at the hub."""
    d = displayed.groupBy("room", "id").agg(F.min("at").alias("displayed_at"))
    h = received.groupBy("room", "id").agg(F.min("at").alias("received_at"))
    joined = shown.join(d, ["room", "id"], "left").join(h, ["room", "id"], "left")
    return joined.withColumn("delivered_at", F.coalesce("displayed_at", "received_at")).withColumn("via", F.when(F.col("displayed_at").isNotNull(), "display").when(F.col("received_at").isNotNull(), "hub"))


class _Island:
    """Expectations and nudges of one island of time: each expectation, in order of seq, takes the first free nudge in its window."""

    def __init__(self, key: tuple):
        self.key, self.wants, self.got = key, [], []

    def row(self, x) -> list[tuple]:
        if x.kind == 0:
            self.wants.append((x.id, x.lo, x.hi))
        else:
            self.got.append((x.lo, x.id))
        return []

    def end(self) -> list[tuple]:
        self.got.sort()
        free, out = list(range(len(self.got) + 1)), []  # free[i]: the first free place from i on, halved as it is followed

        def first(i: int) -> int:
            while free[i] != i:
                free[i] = free[free[i]]
                i = free[i]
            return i

        for seq, lo, hi in sorted(self.wants):
            i = first(bisect.bisect_left(self.got, (lo,)))
            hit = i < len(self.got) and self.got[i][0] <= hi
            if hit:
                free[i] = i + 1
            out.append((*self.key[:2], seq, self.got[i][1] if hit else None, hit))
        return out


def match_expected(expected: DataFrame, shown: DataFrame, early: float = 1.0) -> DataFrame:
    """Expectations (run, key, seq, lo, hi) matched one to one with nudges (run, key, at, id): each takes the first free one in its window.

    The greedy order is sequential where windows overlap. Windows that don't, even through others, can't compete; so time is cut into
    islands of overlapping windows, and a task holds one island at a time, without nudges that no window reaches.
    """
    want = expected.select("run", "key", F.lit(0).alias("kind"), F.col("seq").alias("id"), (F.col("lo") - early).alias("lo"), "hi")
    got = shown.select("run", "key", F.lit(1).alias("kind"), "id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    w = Window.partitionBy("run", "key").orderBy("lo", "kind", "id")
    reached = F.max(F.when(F.col("kind") == 0, F.col("hi"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when((F.col("kind") == 0) & (reached.isNull() | (F.col("lo") > reached)), 1).otherwise(0)
    placed = want.union(got).withColumn("_fresh", fresh).withColumn("_reached", reached).withColumn("island", F.sum("_fresh").over(w))
    placed = placed.where((F.col("kind") == 0) | (F.col("lo") <= F.col("_reached"))).drop("_fresh", "_reached")
    return in_order(placed, ["run", "key", "island"], ["kind"], _Island, "run long, key string, seq long, id long, found boolean")


def precision_recall(matched: DataFrame, shown: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall over all runs."""
    m = matched.agg(F.count_if("found").alias("tp"), F.count_if(~F.col("found")).alias("fn"))
    both = m.crossJoin(shown.agg(F.count("*").alias("shown")))
    return both.select("tp", (F.col("shown") - F.col("tp")).alias("fp"), "fn", F.round(F.try_divide("tp", "shown"), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def rooms(events: DataFrame) -> DataFrame:
    """Each room's last event and number of nudges, the latest first."""
    return events.groupBy("room").agg(F.max("at").alias("last_seen"), F.count_if(F.col("type") == "nudge").alias("nudges")).orderBy(F.desc("last_seen"), "room")


def newest(events: DataFrame, most: int) -> DataFrame:
    """The last events of each room, numbered from 1 backwards."""
    place = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("at"), F.desc("id")))
    return events.withColumn("back", place).where(F.col("back") <= most)


def latest_state(updates: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Each field's last non-null value: updates upserted in order."""
    last = lambda f: F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.struct(*order)))
    return updates.groupBy(*keys).agg(*[last(f).alias(f) for f in fields])
