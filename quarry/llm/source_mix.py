"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent and normalised. The exponent is
bisected: entropy falls and repetition falls too as it grows from 0 (all alike) to 1
(as it is). Each source's weight becomes a token budget: whole passes over the source, and of one
more pass as many blocks, in an order permuted anew for each pass, as the budget has room for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

#: A token, for counting: a run of anything but white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The exponent's range is cut in ``PARTS`` so many times: to 2 ** -60.
ROUNDS, PARTS = 15, 16


@dataclass(frozen=True)
class Mix:
    """Exponent, weights by source, and the token budget of the whole."""

    exponent: float
    weights: dict
    budget: float

    @property
    def entropy(self) -> float:
        """In nats."""
        return -sum(w * math.log(w) for w in self.weights.values() if w > 0)


def _weights(tokens: dict, exponent: float) -> dict:
    top = max(tokens.values())
    raw = {s: (t / top) ** exponent for s, t in tokens.items()}
    total = sum(raw.values())
    return {s: r / total for s, r in raw.items()}


def _exponent(n: int, top: int, low: int, sums, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The exponent for ``n`` sources of ``low`` to ``top`` tokens.

    ``sums`` gives for each of a list of exponents the sum of (tokens / top) ** exponent over all sources, and
    that of the same times log(tokens / top): all that entropy and repetition hang on. The smallest source is repeated most.
    """

    def entropies(points: list[float]) -> list[float]:
        return [(math.log(z) - a * logs / z) / math.log(n) if n > 1 else 1.0 for a, (z, logs) in zip(points, sums(points), strict=True)]

    def repeats(points: list[float]) -> list[float]:
        if budget is None:  # the budget goes through the largest source once
            return [(low / top) ** (a - 1) for a in points]
        return [(low / top) ** a / z * budget / low for a, (z, _) in zip(points, sums(points), strict=True)]

    def least(held) -> float:
        """The least exponent from which on ``held`` is true; 1 if it is nowhere below."""
        if held([0.0])[0]:
            return 0.0
        lower, upper = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [lower + (upper - lower) * i / PARTS for i in range(1, PARTS)]
            at = [*held(points), True].index(True)
            lower, upper = [lower, *points][at], [*points, upper][at]
        return upper

    found = [0.0]
    if target_entropy is not None:
        found.append(least(lambda points: [e <= target_entropy for e in entropies(points)]))
    if max_repeats is not None:
        found.append(least(lambda points: [r <= max_repeats for r in repeats(points)]))
    return max(found)


def solve(tokens: dict, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> Mix:
    """The least exponent of 0 to 1 whose repetition is within ``max_repeats``; or the one that has ``target_entropy`` (as a share of the greatest possible).

    With both, the larger exponent: the limit goes before the target. A target that the sources exceed already
    leaves them as they are (exponent 1). Without ``budget``, it is the smallest with which every source is
    gone through once.
    """
    tokens = {s: t for s, t in tokens.items() if t > 0}
    if not tokens:
        return Mix(1.0, {}, 0.0)
    top = max(tokens.values())

    def sums(points: list[float]) -> list[tuple[float, float]]:
        return [(math.fsum((t / top) ** a for t in tokens.values()), math.fsum((t / top) ** a * math.log(t / top) for t in tokens.values())) for a in points]

    exponent = _exponent(len(tokens), top, min(tokens.values()), sums, target_entropy, max_repeats, budget)
    weights = _weights(tokens, exponent)
    return Mix(exponent, weights, float(budget or max(t / weights[s] for s, t in tokens.items())))


def _plan(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> DataFrame:
    """(source, passes, rest) of (source, tokens): whole passes, and the tokens of one more. A source without tokens is passed once.

    The driver sees counts and sums over sources only, by the rules of ``solve``.
    """
    n, top, low = totals.where("tokens > 0").agg(F.count(F.lit(1)), F.max("tokens"), F.min("tokens")).first()
    if not n:
        return totals.select("source", F.lit(1).alias("passes"), F.lit(0).cast("long").alias("rest"))
    share = F.col("tokens") / F.lit(float(top))

    def sums(points: list[float]) -> list[tuple[float, float]]:
        raw = [F.pow(share, F.lit(a)) for a in points]
        row = totals.where("tokens > 0").agg(*[F.sum(r) for r in raw], *[F.sum(r * F.log(share)) for r in raw]).first()
        return list(zip(row[: len(points)], row[len(points) :], strict=True))

    exponent = _exponent(n, top, low, sums, target_entropy, max_repeats, budget)
    exact = F.pow(share, F.lit(exponent - 1.0)) if budget is None else F.pow(share, F.lit(exponent)) * (budget / sums([exponent])[0][0]) / F.col("tokens")
    placed = totals.withColumn("exact", F.when(F.col("tokens") > 0, exact).otherwise(1.0)).withColumn("passes", F.floor(F.col("exact") + 1e-9).cast("int"))
    rest = F.greatest(F.lit(0), F.round((F.col("exact") - F.col("passes")) * F.col("tokens"))).cast("long")
    return placed.select("source", "passes", rest.alias("rest"))


def _number(text: Column, digits: int = 8) -> Column:
    """A number of so many hexadecimal digits, drawn by a text."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(digits)), 16, 10).cast("long")


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def temperature_mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, max_repeats: float | None = None,
    budget: float | None = None, blocks: int = 1024, seed: int = 7, prefix: str = "mix_",
) -> DataFrame:
    """A row for each time that a document stands in the mix, all columns kept, with ``mix_tokens``, ``mix_pass``, ``mix_block`` and ``mix_key``.

    Sorting by ``mix_key`` gives the mixed order: whole blocks of all sources shuffled together, so every
    stretch of it has about the target weights.

    A source's budget is met to within one part in ``blocks`` squared of the source, or one document. Null
    sources are one source. Documents without tokens (null or blank text) stand in each pass where their block
    does; a source without any token is passed once. Documents go to blocks by id and length, so rows of one id and length go
    together; repeated rows count each. Empty input: no rows. Columns named like an added one are replaced.

    Sources may be many, such as hosts: their budgets are a table, which goes to all tasks only if it is small.
    """
    docs = docs.drop(*[f"{prefix}{c}" for c in ("tokens", "pass", "block", "key")])
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    drawn = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.octet_length(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("row"), source.alias("source"), count_tokens(F.col(text_col)).alias("tokens"), _number(drawn).alias("slot"))
    rows = rows.withColumns({"block": (F.col("slot") % blocks).cast("int"), "part": (F.floor(F.col("slot") / blocks) % blocks).cast("int")})
    # the places of all documents, without their texts
    light = cut(rows.groupBy("source", "block", "part").agg(F.sum("tokens").alias("tokens")), "mix")
    totals = cut(light.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix")
    # tables of one row a source: written first, so that their sizes are known where they are joined
    plan = cut(_plan(totals, target_entropy, max_repeats, budget), "mix")
    order, inner = _order(seed, F.col("passes"), F.col("block")), _order(seed, F.col("passes"), F.col("block"), F.col("part"))
    placed = light.join(plan, "source").withColumns({"order": order, "inner": inner})
    border = cut(_border(placed.groupBy("source", "rest", "order").agg(F.sum("tokens").alias("tokens")), "order"), "mix")
    within = placed.join(border, ["source", "order"]).groupBy("source", F.col("left").alias("rest"), "inner").agg(F.sum("tokens").alias("tokens"))
    last = _border(within, "inner").select("source", F.col("inner").alias("inner_border"))
    limits = cut(plan.join(border.select("source", F.col("order").alias("order_border")), "source", "left").join(last, "source", "left"), "mix")

    chosen = rows.join(limits, "source").withColumns({"order": order, "inner": inner})
    # without a border all of the source fits; that happens only where rest is its whole
    more = F.when(F.col("rest") <= 0, False).otherwise(
        F.coalesce(F.col("order") < F.col("order_border"), F.lit(True)) | ((F.col("order") == F.col("order_border")) & F.coalesce(F.col("inner") < F.col("inner_border"), F.lit(True)))
    )
    times = F.col("passes") + F.when(more, 1).otherwise(0)
    out = chosen.withColumn("pass", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    key = _number(F.concat_ws(":", F.lit(str(seed)), "source", F.col("pass").cast("string"), F.col("block").cast("string")), 15)
    return out.select("row.*", F.col("tokens").alias(f"{prefix}tokens"), F.col("pass").alias(f"{prefix}pass"), F.col("block").alias(f"{prefix}block"), key.alias(f"{prefix}key"))


def _order(seed: int, *places: Column) -> Column:
    return _number(F.concat_ws(":", F.lit(f"{seed} order"), F.col("source"), *[p.cast("string") for p in places]))


def _border(sums: DataFrame, by: str) -> DataFrame:
    """Of each source the first place, in order, whose tokens no longer fit in the rest, and what is left before it."""
    upto = F.sum("tokens").over(W.partitionBy("source").orderBy(by))
    over = sums.withColumn("upto", upto).where("upto > rest")
    return over.groupBy("source").agg(F.min_by(F.struct(F.col(by), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")), by).alias("b")).select("source", f"b.{by}", "b.left")
