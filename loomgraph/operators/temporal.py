"""Ordered analytics: growth by week, carried states, reactions, lead and lag, life cycles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.session import checkpointed


def weekly_growth(stamped: DataFrame) -> DataFrame:
    """(uid, week, added_in, added_out, total): edges (src, dst, stamp) by week of either end, weeks without any filled in, and the running sum."""
    ends = stamped.select(F.col("src").alias("uid"), "stamp", F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(stamped.select(F.col("dst").alias("uid"), "stamp", F.lit(1).alias("i"), F.lit(0).alias("o")))
    weekly = ends.groupBy("uid", F.date_trunc("week", "stamp").cast("date").alias("week")).agg(F.sum("i").alias("added_in"), F.sum("o").alias("added_out"))
    spine = weekly.groupBy("uid").agg(F.min("week").alias("first"), F.max("week").alias("last")).select("uid", F.explode(F.expr("sequence(first, last, interval 7 days)")).alias("week"))
    filled = spine.join(weekly, ["uid", "week"], "left").select("uid", "week", F.coalesce("added_in", F.lit(0)).alias("added_in"), F.coalesce("added_out", F.lit(0)).alias("added_out"))
    upto = Window.partitionBy("uid").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("total", F.sum(F.col("added_in") + F.col("added_out")).over(upto))


def peak_week(growth: DataFrame) -> DataFrame:
    """The first week of most added edges of each node."""
    top = growth.withColumn("added", F.col("added_in") + F.col("added_out")).withColumn("k", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("added"), "week")))
    return top.where("k = 1").select("uid", "week", "added")


def first_edges(stamped: DataFrame, k: int = 3) -> DataFrame:
    """The first incoming edges of each node, those without a stamp last."""
    order = Window.partitionBy("dst").orderBy(F.col("stamp").asc_nulls_last(), "type", "src")
    return stamped.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def carry_forward(changes: DataFrame, rounds: int) -> DataFrame:
    """(uid, round, value) for rounds 1 to `rounds`: the last write of a round counts, and holds until the next; 0 before any."""
    last = changes.groupBy("uid", "round").agg(F.max_by("new", "seq").alias("new"))
    spine = last.select("uid").distinct().select("uid", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    filled = spine.join(last, ["uid", "round"], "left")
    upto = Window.partitionBy("uid").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("uid", "round", F.coalesce(F.last("new", ignorenulls=True).over(upto), F.lit(0.0)).alias("value"))


#: Series of one block, bands of the spectrum that bound a pair, and share of a block pair's cells above which all of them are computed at once.
SERIES_BLOCK, BANDS, DENSE = 256, 8, 0.1


def _band_sizes(z: np.ndarray, lags: int) -> np.ndarray:
    """Root of each series' energy in bands of its spectrum: no product of two series, at any lag, exceeds that of these."""
    size = z.shape[1] + lags
    power = np.abs(np.fft.rfft(z, size, axis=1)) ** 2 / size
    power[:, 1 : (size + 1) // 2] *= 2  # the mirrored half
    edges = np.unique(np.round(np.geomspace(1, power.shape[1] + 1, BANDS + 1)).astype(int)) - 1
    return np.sqrt(np.add.reduceat(power, edges[:-1], axis=1))


def _block_pairs(lags: int, least: float):
    """Of two blocks of series, (a, b, lag, correlation) at all lags of the pairs that are correlated somewhere; few others are computed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                left, right = (np.frombuffer(x, np.float64).reshape(-1, row.width) for x in (row.z, row.other_z))
                n = np.asarray(row.n)
                bound = _band_sizes(left, lags) @ _band_sizes(right, lags).T / n[:, None]
                i, j = np.nonzero(bound > least - 1e-5)
                if row.block == row.other:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                whole = len(i) > DENSE * bound.size
                found = np.full((len(i), 2 * lags + 1), np.nan)
                for lag in range(-lags, lags + 1):
                    x, y = left[:, max(lag, 0) : row.width + min(lag, 0)], right[:, max(-lag, 0) : row.width - max(lag, 0)]
                    dot = (x @ y.T)[i, j] if whole else np.einsum("ij,ij->i", x[i], y[j])
                    found[:, lag + lags] = np.where(abs(lag) <= n[i] // 2, dot / n[i], np.nan)
                near = np.flatnonzero(np.nanmax(np.abs(found), axis=1) > least - 1e-5)
                a, b = np.asarray(row.uids)[i[near]], np.asarray(row.other_uids)[j[near]]
                lag = np.tile(np.arange(-lags, lags + 1, dtype=np.int32), len(near))
                out = pd.DataFrame({"a": np.repeat(a, 2 * lags + 1), "b": np.repeat(b, 2 * lags + 1), "lag": lag, "correlation": found[near].ravel()})
                yield out[out["correlation"].notna()]

    return run


def lagged_correlation(series: DataFrame, lags: int = 3, least: float = 0.7, k: int = 20) -> DataFrame:
    """(a, b, correlation, lag): pairs a < b of series (uid, round, value) whose strongest correlation is at a lag other than 0.

    The value of a in round t + lag meets that of b in round t, summed over the rounds that both have. Series that never change have no
    correlation. Series are packed into blocks of SERIES_BLOCK in the order of their names; a row of two blocks bounds all of its
    pairs at once by the energies of their spectra in a few bands, whatever the lag, and only pairs that the bounds cannot dismiss are computed. So no
    pair becomes a row unless it is correlated, and what is shuffled grows with series x blocks.
    """
    stats = series.groupBy("uid").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).where("sd > 1e-10 AND n >= 3")
    span = series.agg(F.min("round").alias("first"), F.max("round").alias("last")).first()
    first, width = span["first"] or 0, (span["last"] or 0) - (span["first"] or 0) + 1
    points = F.collect_list(F.struct((F.col("round") - first).cast("int").alias("at"), ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z")))
    normal = checkpointed(series.join(stats, "uid").groupBy("uid", "n").agg(points.alias("points")))
    cuts = max(1, -(-normal.count() // SERIES_BLOCK))
    placed = normal.repartitionByRange(cuts, "uid").withColumn("part", F.spark_partition_id())
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("uid")) - 1).withColumn("in_part", F.floor(F.col("nth") / SERIES_BLOCK).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros((len(group), width))
        group = group.sort_values("nth")
        for row, points in enumerate(group["points"]):
            for p in points:
                z[row, p["at"]] += p["z"]
        return pd.DataFrame({"part": [group["part"].iloc[0]], "in_part": [group["in_part"].iloc[0]], "uids": [group["uid"].tolist()], "n": [group["n"].tolist()], "z": [z.tobytes()]})

    packed = checkpointed(checkpointed(placed).groupBy("part", "in_part").applyInPandas(pack, "part int, in_part int, uids array<string>, n array<long>, z binary"))
    order = packed.select("part", "in_part").withColumn("block", F.row_number().over(Window.orderBy("part", "in_part")))  # one row for each block
    blocks = packed.join(F.broadcast(order), ["part", "in_part"]).drop("part", "in_part")
    total = order.count()
    left = blocks.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(total))))
    right = blocks.select(F.col("block").alias("other"), F.col("uids").alias("other_uids"), F.col("z").alias("other_z"))
    met = left.join(right, "other").withColumn("width", F.lit(width))
    found = met.mapInPandas(_block_pairs(lags, least), "a string, b string, lag int, correlation double")
    products = found.select("a", "b", "lag", F.round("correlation", 6).alias("correlation"))
    best = products.withColumn("k", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.abs("correlation")), "lag"))).where("k = 1 AND lag <> 0").where(F.abs("correlation") > least)
    return best.select("a", "b", "correlation", "lag").orderBy(F.desc(F.abs("correlation")), "a", "b").limit(k)


def life_cycle(changes: DataFrame, hot: float = 0.1, cold: float = -0.05, signed: bool = True) -> DataFrame:
    """(uid, phases): inactive, then activated and overheated on each strong rise, cooling on a fall while overheated; stable at the end if it cooled or never began.

    With signed=False falls are measured by their size, as in the published code, so that cooling never comes.
    """
    delta = F.col("delta") if signed else F.abs("delta")
    steps = changes.withColumn("e", F.when(delta > hot, "hot").when(delta < cold, "cold")).where("e IS NOT NULL")
    before = F.lag("e").over(Window.partitionBy("uid").orderBy("seq"))
    turns = steps.withColumn("was", before).where("(e = 'hot' AND (was IS NULL OR was = 'cold')) OR (e = 'cold' AND was = 'hot')")
    told = turns.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda s: s["e"]).alias("es"))
    out = changes.select("uid").distinct().join(told, "uid", "left").withColumn("es", F.coalesce("es", F.array().cast("array<string>")))
    phases = F.flatten(F.transform("es", lambda e: F.when(e == "hot", F.array(F.lit("activated"), F.lit("overheated"))).otherwise(F.array(F.lit("cooling")))))
    end = F.when((F.size("es") == 0) | (F.element_at(F.concat(F.array(F.lit("cold")), F.col("es")), -1) == "cold"), F.array(F.lit("stable"))).otherwise(F.array().cast("array<string>"))
    return out.select("uid", F.concat(F.array(F.lit("inactive")), phases, end).alias("phases"))


def reactions(causes: DataFrame, acts: DataFrame, most: int = 5) -> DataFrame:
    """Of each cause (cause, group, round): how many acts (act, group, actor, round) of its group follow within `most` rounds, their mean delay, the first actor, and the first ten in order.

    An interval join: rounds are equi-joined after each cause is repeated for every round that it reaches.
    """
    reached = causes.withColumn("at", F.explode(F.expr(f"sequence(round, round + {most})")))
    hits = reached.join(acts.select("group", F.col("round").alias("at"), "act", "actor"), ["group", "at"]).withColumn("delay", F.col("at") - F.col("round"))
    ranked = hits.withColumn("k", F.row_number().over(Window.partitionBy("cause").orderBy("delay", "act")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("k", "actor")))), lambda s: s["actor"])
    return ranked.groupBy("cause").agg(F.count("*").alias("reactions"), F.round(F.avg("delay"), 6).alias("mean_delay"), F.array_join(first, ",").alias("order"))
