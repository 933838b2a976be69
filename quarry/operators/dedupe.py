"""Duplicates: the first of equal keys stays; near copies are found by an exact prefix-filtered set join and merged greedily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ranks import running_totals
from ..functions.storage import checkpoint

LEAST_SIMILARITY, SHINGLE = 0.8, 5


def keep_first(rows: DataFrame, keys: list[str], order: list[Column], id_column: str) -> DataFrame:
    """One row for each key, the first in order, with how many there were. An ordered minimum, so a hot key is combined before it is shuffled."""
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id_column).alias(id_column))
    return rows.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("n")).select(*keys, F.col(f"first.{id_column}").alias(id_column), "n")


def shingle_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Rows (market, doc_id, sh): each document's distinct shingles of n words as sorted 64-bit hashes; fewer words are one shingle."""
    ws = docs.select("market", "doc_id", text.words(F.col("text")).alias("ws"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - n, F.lit(0))), lambda i: F.xxhash64(*[F.get("ws", i + k) for k in range(n)]))
    short = F.array(F.xxhash64(F.array_join("ws", " ")))
    return ws.select("market", "doc_id", F.sort_array(F.array_distinct(F.when(F.size("ws") >= n, runs).otherwise(short))).alias("sh"))


def classes(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Rows (market, doc_id, class_id): documents of a market with the same set of shingles share the smallest doc_id. No market is one too.

    Keys are kept before they are joined: a filter on them would be moved below the words and would find all words again for each word.
    """
    return _classed(checkpoint(_keyed(shingle_sets(docs, n)).drop("sh")))


def _keyed(sets: DataFrame) -> DataFrame:
    return sets.withColumn("key", F.sha2(F.array_join(F.col("sh").cast("array<string>"), ","), 256))


def _classed(keyed: DataFrame) -> DataFrame:
    first = keyed.groupBy("market", "key").agg(F.min("doc_id").alias("class_id"))
    same = F.col("k.market").eqNullSafe(F.col("f.market")) & (F.col("k.key") == F.col("f.key"))
    return keyed.alias("k").join(first.alias("f"), same).select("k.market", "k.doc_id", "f.class_id")


def near_pairs(docs: DataFrame, similarity: float = LEAST_SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """Pairs (market, a, b, jaccard), a < b, of class representatives whose shingle sets are similar enough. Exact.

    Shingles are hashed once and ordered by how many sets hold them, the rarest first. Sets as similar as that share one of their first
    m - ceil(s m) + 1 shingles (m: a set's size), and what is left behind a shared one must still suffice: most pairs are dropped by place
    and length before any set is compared. A shingle's sets are paired only among those heads, so what many documents share is hardly met.
    Until then a set is a number, and a shingle its hash with the market's: what moves for each shingle is two numbers.
    """
    keyed = checkpoint(_keyed(shingle_sets(docs.where("market is not null"), n)))
    sets = keyed.groupBy("market", "key").agg(F.min_by("sh", "doc_id").alias("sh"), F.min("doc_id").alias("doc_id")).drop("key")
    sets = checkpoint(sets.withColumn("id", F.monotonically_increasing_id()))
    each = sets.select("id", "market", F.explode("sh").alias("s")).select("id", F.xxhash64("market", "s").alias("s")).repartition("s")
    # Over one set if its least and greatest are not the same: so counting reads the same rows as the join, which are moved once for both.
    df = each.groupBy("s").agg(F.count("*").alias("df"), F.min("id").alias("_least"), F.max("id").alias("_most")).where("_least <> _most").select("s", "df")
    # A set's shingles that no other set holds come first: only how many they are matters.
    ranked = each.join(df, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared")).join(sets.select("id", F.size("sh").alias("m")), "id")
    alone = F.col("m") - F.size("shared")
    prefix = F.greatest(F.col("m") - F.ceil(F.col("m") * similarity) + 1 - alone, F.lit(0)).cast("int")
    heads = ranked.where(prefix > 0).select("id", "m", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), prefix)).alias("p", "x"))
    heads = heads.select("id", "m", (F.col("alone") + F.col("p")).alias("at"), F.col("x.s").alias("s"))
    a, b = heads.alias("a"), heads.alias("b")
    enough = F.ceil(similarity / (1 + similarity) * (F.col("a.m") + F.col("b.m")) - 1e-9)
    left = F.least(F.col("a.m") - F.col("a.at"), F.col("b.m") - F.col("b.at"))
    fits = (F.col("a.id") < F.col("b.id")) & (F.col("a.m") >= similarity * F.col("b.m")) & (F.col("b.m") >= similarity * F.col("a.m"))
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & fits)
    # the place filter holds at a pair's first shared shingle, where nothing shared stands before
    first = met.groupBy(F.col("a.id").alias("_a"), F.col("b.id").alias("_b")).agg(F.max(left - enough).alias("slack")).where("slack >= 0").select("_a", "_b")
    sides = [sets.select(F.col("id").alias(f"_{x}"), F.col("market").alias(f"{x}_market"), F.col("doc_id").alias(x), F.col("sh").alias(f"{x}_sh")) for x in ("a", "b")]
    both = first.join(sides[0], "_a").join(sides[1], "_b").withColumn("common", F.size(F.array_intersect("a_sh", "b_sh")))
    # not a condition of the join, or else the sets would be moved by id alone and by id and market
    jaccard = F.when((F.col("a_market") == F.col("b_market")) & (F.col("a") != F.col("b")), F.col("common") / (F.size("a_sh") + F.size("b_sh") - F.col("common")))
    return both.select(F.col("a_market").alias("market"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard.alias("jaccard")).where(F.col("jaccard") >= similarity)


def greedy_merge(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b), a standing before b: the rows that go, each with the kept row it goes to: (gone, kept).

    A row stays if no row before it that stays is its neighbour. All rows whose earlier neighbours are decided are decided at once.
    """
    edges = checkpoint(pairs.select("a", "b").distinct())
    state = checkpoint(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        before = edges.join(state.select(F.col("v").alias("a"), "kept"), "a").groupBy("b").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("near"), F.bool_or(F.col("kept").isNull()).alias("wait"))
        joined = state.join(before, F.col("v") == F.col("b"), "left")
        fresh = F.when(F.col("near"), False).when(F.col("wait"), F.lit(None).cast("boolean")).otherwise(True)
        state = checkpoint(joined.select("v", F.coalesce("kept", F.when(F.col("near").isNull(), True).otherwise(fresh)).alias("kept")))
    kept = state.where("kept").select(F.col("v").alias("a"))
    gone = state.where("not kept").select(F.col("v").alias("b"))
    return edges.join(kept, "a").join(gone, "b").groupBy(F.col("b").alias("gone")).agg(F.min("a").alias("kept"))


def sources_of(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """For each key, the other places a kept row was found in: all sources, sorted, without the first."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(source)).alias("all")).select(*keys, F.element_at("all", 1).alias("source"), F.slice("all", F.lit(2), F.greatest(F.size("all"), F.lit(1))).alias("also_found_in"))


def row_numbers(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds n, from 1 in order within each group, without bringing a group together."""
    return running_totals(rows, [group], [order], name="n")
