"""Calls as tables of utterances: turns, clocks, rolling evidence, compliance, frustration, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import in_order

WORDS_PER_SECOND, LINE_GAP_S, START_S = 2.6, 0.7, 0.5


def turn_changes(rows: DataFrame, call: str, order: list[str], speaker: str) -> DataFrame:
    """Adds turn_no, from 0: neighbouring utterances of one speaker are one turn."""
    w = Window.partitionBy(call).orderBy(*order)
    changed = F.when(F.lag(speaker).over(w).isNull() | (F.lag(speaker).over(w) != F.col(speaker)), 1).otherwise(0)
    return rows.withColumn("_c", changed).withColumn("turn_no", F.sum("_c").over(w) - 1).drop("_c")


def grouped(rows: DataFrame, call: str, order: list[str], speaker: str, at: str, gap_s: float = 2.5) -> DataFrame:
    """Adds group_no: a group ends with a change of speaker or a pause; at is in seconds."""
    w = Window.partitionBy(call).orderBy(*order)
    fresh = F.lag(speaker).over(w).isNull() | (F.lag(speaker).over(w) != F.col(speaker)) | (F.col(at) - F.lag(at).over(w) >= gap_s)
    return rows.withColumn("_f", F.when(fresh, 1).otherwise(0)).withColumn("group_no", F.sum("_f").over(w) - 1).drop("_f")


def virtual_clock(rows: DataFrame, call: str, order: list[str], words: Column) -> DataFrame:
    """Adds start_s and end_s of scripted lines, each as long as its words take, with a pause between."""
    w = Window.partitionBy(call).orderBy(*order)
    timed = rows.withColumn("_d", words / WORDS_PER_SECOND)
    before = F.coalesce(F.sum(F.col("_d") + LINE_GAP_S).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return timed.withColumn("start_s", F.round(START_S + before, 3)).withColumn("end_s", F.round(START_S + before + F.col("_d"), 3)).drop("_d")


def rolling_least(rows: DataFrame, call: str, at_s: str, value: str, seconds: int, name: str) -> DataFrame:
    """Adds the least value of the seconds up to and with each row; at_s is whole seconds."""
    w = Window.partitionBy(call).orderBy(at_s).rangeBetween(-seconds, 0)
    return rows.withColumn(name, F.min(value).over(w))


class _Average:
    """The exponential average of one call's scores, from 0."""

    def __init__(self, alpha: float, threshold: float):
        self.alpha, self.threshold, self.level = alpha, threshold, 0.0

    def row(self, x) -> list[tuple]:
        before, self.level = self.level, self.alpha * float(x[-1]) + (1 - self.alpha) * self.level
        return [(*x[:-1], self.level, self.level >= self.threshold and self.level > before)]

    def end(self) -> list[tuple]:
        return []


def frustration(rows: DataFrame, call: str, order: list[str], score: str, alpha: float = 0.5, threshold: float = 0.45) -> DataFrame:
    """Rows (call, *order, level, fires): the exponential average of all scores so far, firing where it is high and rising. Any alpha from 0 to 1."""
    kept = rows.select(call, *order, score)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return in_order(kept, [call], order, lambda key: _Average(alpha, threshold), f"{schema}, level double, fires boolean")


def frustration_score(hits: Column, repeated: Column, sentiment: Column) -> Column:
    """A statement's score, 1 at most: half for each frustrated phrase, 0.4 for repeating oneself, up to 0.6 for a sentiment of -0.3 or less."""
    low = F.when(sentiment <= -0.3, -sentiment * 0.6).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 * hits + F.when(repeated, 0.4).otherwise(0.0) + F.coalesce(low, F.lit(0.0)))


class _Debounce:
    """Takes a row if enough time has passed since the last one taken: the state is one time."""

    def __init__(self, gap: float):
        self.gap, self.last = gap, None

    def row(self, x) -> list[tuple]:
        if self.last is not None and x[1] - self.last < self.gap:
            return []
        self.last = x[1]
        return [tuple(x)]

    def end(self) -> list[tuple]:
        return []


def debounced(rows: DataFrame, key: str, at: str, id_column: str, gap_s: float) -> DataFrame:
    """Rows (key, at, id) that are gap_s or more after the last one taken before them; at is in seconds."""
    kept = rows.select(key, at, id_column)
    return in_order(kept, [key], [at, id_column], lambda k: _Debounce(gap_s), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema))


def rolling_buffer(rows: DataFrame, key: str, at_us: str, seconds: float, confidence: str) -> DataFrame:
    """Adds n_heard and average_confidence of what was heard in the seconds up to and with each row; at_us is whole microseconds.

    The latest of the buffer is the row itself: each row supersedes what was said before it.
    """
    w = Window.partitionBy(key).orderBy(at_us).rangeBetween(-int(seconds * 1_000_000), 0)
    return rows.withColumn("n_heard", F.count("*").over(w)).withColumn("average_confidence", F.avg(confidence).over(w))


def disclosed_before(rows: DataFrame, call: str, order: list[str], disclosure: Column, quote: Column) -> DataFrame:
    """Rows that quote before the call's first disclosure."""
    w = Window.partitionBy(call).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_d", F.coalesce(F.bool_or(disclosure).over(w), F.lit(False))).where(quote & ~F.col("_d")).drop("_d")


def deadline_missed(rows: DataFrame, call: str, at: str, agent: Column, disclosure: Column, seconds: float) -> DataFrame:
    """Calls (call, first_agent, first_disclosure) without a disclosure within seconds of the agent's first words. Two minima, no sort."""
    seen = rows.groupBy(call).agg(F.min(F.when(agent, F.col(at))).alias("first_agent"), F.min(F.when(agent & disclosure, F.col(at))).alias("first_disclosure"), F.max(at).alias("last"))
    due = F.col("first_agent") + seconds
    return seen.where((F.col("last") > due) & (F.col("first_disclosure").isNull() | (F.col("first_disclosure") > due))).drop("last")


def streaks(rows: DataFrame, call: str, order: list[str], bad: Column) -> DataFrame:
    """Adds streak: how many bad rows in a row end here; 0 on a good one."""
    w = Window.partitionBy(call).orderBy(*order)
    marked = rows.withColumn("_b", bad.cast("int")).withColumn("_i", F.sum(1 - F.col("_b")).over(w))
    run = Window.partitionBy(call, "_i").orderBy(*order)
    return marked.withColumn("streak", F.sum("_b").over(run)).drop("_b", "_i")


def sessionize(rows: DataFrame, key: str, at: str, gap_s: float) -> DataFrame:
    """Sessions (key, session, start, end, n) parted by pauses of more than gap_s; at is in seconds."""
    w = Window.partitionBy(key).orderBy(at)
    marked = rows.withColumn("_f", F.when(F.col(at) - F.lag(at).over(w) <= gap_s, 0).otherwise(1)).withColumn("session", F.sum("_f").over(w))
    return marked.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def as_of_forward(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Adds to left the value of the first right row of its key at or after its time; the key's last one if none is later.

    Both sides are merged in order once; no row meets more than its neighbour.
    """
    l_ = left.withColumn("_side", F.lit(0)).withColumn("_at", F.col(left_at))
    r_ = right.select(key, F.col(right_at).alias("_at"), F.col(value).alias("_v")).withColumn("_side", F.lit(1))
    both = l_.unionByName(r_, allowMissingColumns=True)
    ahead = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.first("_v", ignorenulls=True).over(ahead), F.last("_v", ignorenulls=True).over(behind))
    return both.withColumn(value, found).where("_side = 0").drop("_side", "_at", "_v")
