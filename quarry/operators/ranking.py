"""Best rows under caps, quotas and budgets.

No key's rows are sorted by one task: running sums go by ranges of the order, and what is taken from the top of a key
is cut to its limit before the shuffle. Orders must be total (end them with an id), or ties fall as they come.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.lineage import cut


def running_sum(rows: DataFrame, keys: list[str], cost: str, *order, out: str = "total ") -> DataFrame:
    """``rows`` with the sum of ``cost`` over those of their key up to them, in order.

    Rows are dealt to ranges of key and order, written to the shared folder (a range must stay what it was), and
    summed within each; the ranges before it add one number for each key.
    """
    spread = cut(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("range ", F.spark_partition_id()), "ranges")
    parts = spread.groupBy(*keys, "range ").agg(F.sum(cost).alias("sum "))
    before = F.sum("sum ").over(W.partitionBy(*keys).orderBy("range ").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(F.struct(*keys, "range ").alias("at "), F.coalesce(before, F.lit(0)).alias("before "))
    same = reduce(lambda a, k: a & spread[k].eqNullSafe(F.col(f"`at `.`{k}`")), keys, spread["range "] == F.col("`at `.`range `"))
    within = F.sum(cost).over(W.partitionBy(*keys, "range ").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return spread.join(parts, same).withColumn(out, within + F.col("before ")).drop("range ", "at ", "before ")


def best_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place ", place).where(F.col("place ") == 1).drop("place ")


def top_per(rows: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` of each key, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def _first_then_rest(rows: DataFrame, group: str, quota: Column, most: int, limit: int, *order) -> DataFrame:
    """``limit`` rows: those within their group's quota (``most`` at most), in order; then the rest, in order.

    If the former are fewer than ``limit``, twice as many rows from the top of all hold enough of the rest, and a row's
    place in its group is the same among them.
    """
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    first = rows.withColumn("place ", place).where(F.col("place ") <= most).where(F.col("place ") <= quota)
    rest = rows.orderBy(*order).limit(2 * limit).withColumn("place ", place).where(F.col("place ") > quota)
    both = first.withColumn("over ", F.lit(False)).unionByName(rest.withColumn("over ", F.lit(True)))
    return both.orderBy("over ", *order).limit(limit).drop("over ", "place ")


def capped_first(rows: DataFrame, group: str, n: int, limit: int, *order) -> DataFrame:
    """``limit`` rows: those within the first ``n`` of their group, in order; then the rest, in order."""
    return _first_then_rest(rows, group, F.lit(n), n, limit, *order)


def with_quota(rows: DataFrame, group: str, limit: int, *order, quota: int | None = None) -> DataFrame:
    """``limit`` rows in which each group has at least its first max(limit / 5, 5), as far as there is room."""
    quota = max(limit // 5, 5) if quota is None else quota
    return capped_first(rows, group, quota, limit, *order).orderBy(*order)


def _by_name(names) -> list[Column]:
    """Order of columns by name; a hyphen before a name turns it round."""
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def within_budget(rows: DataFrame, keys: list[str], cost: str, budget: int, *order) -> DataFrame:
    """Rows of each key in order, up to the first that would pass the budget. Costs are 0 or more; null ones cost nothing.

    Orders are columns, or names (``"-score"``, ``"id"``). With names only keys, order and cost are written and summed, and
    whole rows are looked up again by these: other columns, such as texts, are read for what is kept.
    """
    counted = rows.withColumn("cost ", F.coalesce(F.col(cost), F.lit(0)))
    if not all(isinstance(o, str) for o in order):
        return running_sum(counted, keys, "cost ", *order).where(F.col("total ") <= budget).drop("total ", "cost ")
    by = [*dict.fromkeys([*keys, *[n.removeprefix("-") for n in order], cost])]
    kept = running_sum(counted.select(*by, "cost "), keys, "cost ", *_by_name(order)).where(F.col("total ") <= budget)
    # a written table tells its size: a small one is sent to the rows, not the rows to it
    kept = cut(kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n ")).select(F.struct(*by).alias("at "), "n "), "kept")
    same = reduce(lambda a, k: a & rows[k].eqNullSafe(F.col(f"`at `.`{k}`")), by, F.lit(True))
    found = rows.join(kept, same)
    place = F.row_number().over(W.partitionBy("at ").orderBy(F.lit(1)))
    return found.withColumn("place ", place).where(F.col("place ") <= F.col("n ")).drop("at ", "n ", "place ")


#: Rounds of sums before what is left of each key is gone through as a stream.
ROUNDS = 3


def skipping_budget(rows: DataFrame, keys: list[str], id_col: str, cost: str, budget: int, order: str) -> DataFrame:
    """(keys, id) of the rows of each key taken in order of ``order`` (descending, then id), passing over those that don't fit.

    Costs are 0 or more; rows with a null cost or more than the budget are passed over. Each round takes all rows up to the first
    that doesn't fit what room is left, then lets go all that don't fit any more. What ``ROUNDS`` of them leave, rows that are smaller than
    the room but come between larger ones, goes through one task a key, sorted, as a stream of ids and costs.
    """
    by = (F.desc(order), F.asc(id_col))
    left = rows.select(*keys, id_col, order, F.col(cost).alias("cost "), F.lit(budget).alias("room ")).where(F.col("cost ") <= budget)
    taken = []
    for n in range(ROUNDS):
        summed = cut(running_sum(left, keys, "cost ", *by), "budget")
        fit = F.col("total ") <= F.col("room ")
        taken.append(summed.where(fit).select(*keys, id_col))
        if summed.where(~fit).isEmpty():
            return reduce(DataFrame.unionByName, taken)
        used = summed.groupBy(*keys).agg(F.coalesce(F.max(F.when(fit, F.col("total "))), F.lit(0)).alias("used ")).select(F.struct(*keys, F.lit(n)).alias("key "), "used ")
        same = reduce(lambda a, k: a & summed[k].eqNullSafe(F.col(f"`key `.`{k}`")), keys, F.lit(True))
        left = summed.where(~fit).join(used, same).withColumn("room ", F.col("room ") - F.col("used ")).where(F.col("cost ") <= F.col("room ")).drop("total ", "used ", "key ")
    ordered = (left.repartition(*keys) if keys else left.coalesce(1)).sortWithinPartitions(*[F.col(k) for k in keys], *by).select(*keys, id_col, "cost ", "room ")
    width = len(keys)

    def fold(batches):
        key, room = None, None
        for batch in batches:
            own = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)) if width else [()] * batch.num_rows
            fits = []
            for k, c, first in zip(own, batch.column("cost ").to_pylist(), batch.column("room ").to_pylist(), strict=True):
                if room is None or k != key:
                    key, room = k, first
                fits.append(c <= room)
                room -= c if fits[-1] else 0
            yield batch.filter(pa.array(fits, pa.bool_())).select(range(width + 1))

    taken.append(ordered.mapInArrow(fold, taken[0].schema))
    return reduce(DataFrame.unionByName, taken)


def scaled_to_ten(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Values as parts of ten of the greatest, to two places; all 0 if none is above 0. The maximum is one small row."""
    top = rows.agg(F.max(value).alias("top "))
    return rows.crossJoin(F.broadcast(top)).withColumn(out, F.when(F.col("top ") > 0, F.bround(F.col(value) * 10.0 / F.col("top "), 2)).otherwise(0.0)).drop("top ")


def picked_percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Of each key the value at place floor(n * p) of its sorted values (no interpolation), and the mean rounded down.

    Rows are counted by value before anything is put in order; places are found by running counts.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count "))
    sums = counts.groupBy(*keys).agg(F.sum("count ").alias("n "), F.floor(F.sum(F.col(value) * F.col("count ")) / F.sum("count ")).alias("mean_down"))
    sums = sums.select(F.struct(*keys, F.lit(0)).alias("key "), "n ", "mean_down")
    placed = running_sum(counts, keys, "count ", F.asc(value))
    same = reduce(lambda a, k: a & placed[k].eqNullSafe(F.col(f"`key `.`{k}`")), keys, F.lit(True))
    place = lambda p: F.least(F.floor(F.col("n ") * p), F.col("n ") - 1)
    pick = lambda p: F.min(F.when(F.col("total ") > place(p), F.col(value)))
    return placed.join(F.broadcast(sums) if not keys else sums, same).groupBy(*keys).agg(*[pick(p).alias(name) for name, p in points.items()], F.first("mean_down").alias("mean_down"))


def weighted(column: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, weight in weights.items():
        out = F.when(column == name, weight).otherwise(out)
    return out


def topic_sum(rows: DataFrame, system: str, kind: str, topic: str, weight: str) -> DataFrame:
    """Per system the sum over (kind, topic) of the greatest weight of each."""
    return rows.groupBy(system, kind, topic).agg(F.max(weight).alias("w ")).groupBy(system).agg(F.sum("w ").alias("raw"), F.count(F.lit(1)).alias("topics"))


def stratified(rows: DataFrame, stratum: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, drawn by a digest of the id."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return top_per(rows, [stratum], n, draw, id_col).drop("rank")


def balanced(rows: DataFrame, category: str, shares: dict[str, float], total: int, *order) -> DataFrame:
    """About ``total`` rows: of each category its share first, then others in order."""
    quotas = {c: float(round(total * s)) for c, s in shares.items()}
    return _first_then_rest(rows, category, weighted(F.col(category), quotas, 0.0), int(max(quotas.values(), default=0)), total, *order)
