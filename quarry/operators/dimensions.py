"""Systems ranked by several dimensions at once: facts, verdicts, scores, their scale, and a judgement, as one plan.

Facts are rows of one long table whatever the dimension; verdicts and grades that a model gave come as columns. No step knows the
names of dimensions, which are keys like others, so a run over one of them can replace its part of an earlier result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a fact of each grade weighs, of another grade, how facts of one topic count, and verdicts that let a fact count.
WEIGHTS = {("conflict", "high"): 3.0, ("conflict", "medium"): 1.5, ("conflict", "low"): 0.7, ("conflict", None): 0.5, ("hub", "strong"): 1.5, ("hub", "weak"): 1.0, ("hub", "loose"): 0.5}
ONCE_A_TOPIC = ("conflict",)
COUNTS = ("confirmed", "uncertain")
SCALE, SHOWN = 10.0, {"conflict": 6, "hub": 3}


def scores(systems: DataFrame, facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """(system, dimension, raw, value, facts, counted, topics): every system in every dimension.

    ``systems``: system; ``facts``: system, dimension, kind, topic, grade, verdict. A fact counts if its verdict is null or lets it; of a dimension in
    ``ONCE_A_TOPIC`` the heaviest fact of a kind and topic does, of another each. Values are parts of ten of the dimension's greatest, to two places; all 0
    if none is above 0. Systems without facts have 0, facts of systems or dimensions that weren't asked for are left out.
    """
    weight = F.lit(0.0)
    for (dimension, grade), w in WEIGHTS.items():
        weight = F.when((F.col("dimension") == dimension) & (F.col("grade") == grade), w).otherwise(weight) if grade else weight
    for (dimension, grade), w in WEIGHTS.items():
        if grade is None:
            known = [g for d, g in WEIGHTS if d == dimension and g]
            weight = F.when((F.col("dimension") == dimension) & ~F.coalesce(F.col("grade").isin(*known), F.lit(False)), w).otherwise(weight)
    rows = facts.where(F.col("dimension").isin(*dimensions)).withColumns({"weight": weight, "counts": F.col("verdict").isNull() | F.col("verdict").isin(*COUNTS)})
    # two levels: hot systems and topics are added up in each task
    topics = rows.groupBy("system", "dimension", "kind", "topic").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if("counts").alias("counted"), F.max(F.when(F.col("counts"), F.col("weight"))).alias("most"), F.sum(F.when(F.col("counts"), F.col("weight")).otherwise(0.0)).alias("all")
    )
    own = F.when(F.col("dimension").isin(*ONCE_A_TOPIC), F.coalesce("most", F.lit(0.0))).otherwise(F.col("all"))
    totals = topics.groupBy("system", "dimension").agg(F.bround(F.sum(own), 9).alias("raw"), F.sum("facts").alias("facts"), F.sum("counted").alias("counted"), F.count_if(F.col("counted") > 0).alias("topics"))
    asked = systems.select("system").where("system is not null").distinct().withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    zero = {"raw": 0.0, "facts": 0, "counted": 0, "topics": 0}
    return scaled(asked.join(totals, ["system", "dimension"], "left").fillna(zero))


def scaled(rows: DataFrame) -> DataFrame:
    """``value`` of rows with (dimension, raw); the greatest of each dimension is one small row."""
    top = rows.groupBy("dimension").agg(F.max("raw").alias("top"))
    value = F.when(F.col("top") > 0, F.bround(F.col("raw") * SCALE / F.col("top"), 2)).otherwise(0.0)
    return rows.drop("value").join(F.broadcast(top), "dimension").select("system", "dimension", "raw", value.alias("value"), "facts", "counted", "topics")


def replaced(before: DataFrame, part: DataFrame) -> DataFrame:
    """An earlier table of scores in which the dimensions of ``part`` are those of ``part``."""
    return before.join(part.select("dimension").distinct(), "dimension", "left_anti").select(*part.columns).unionByName(part)


def evidence(facts: DataFrame, shown: dict[str, int] | None = None) -> DataFrame:
    """(system, dimension, place, kind, topic, grade, verdict): the first facts of each dimension to be shown: by weight, kind and topic.

    Of ``hub`` only strong ones are; each task hands on as many as are shown.
    """
    most = F.lit(0)
    for dimension, n in (SHOWN if shown is None else shown).items():
        most = F.when(F.col("dimension") == dimension, n).otherwise(most)
    grades = F.array_position(F.array(*[F.lit(g) for _, g in WEIGHTS if g]), F.col("grade"))
    rows = facts.where((F.col("dimension") != "hub") | (F.col("grade") == "strong")).where(F.col("verdict").isNull() | F.col("verdict").isin(*COUNTS))
    order = [F.when(grades > 0, grades).asc_nulls_last(), "kind", "topic", "verdict"]
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("system", "dimension").orderBy(*order))).where(F.col("place") <= max((SHOWN if shown is None else shown).values(), default=0))
    return rows.where(F.col("place") <= most).select("system", "dimension", "place", "kind", "topic", "grade", "verdict")


def ranked(scored: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """(rank, system, total, values, grade, rationale): systems by the judge's place, then by their values together, then by name.

    ``judged``: system, place, grade, rationale; systems it leaves out follow. ``values`` is a map from dimension to value.
    """
    from .ranking import running_sum

    rows = scored.groupBy("system").agg(F.bround(F.sum("value"), 2).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "value")))).alias("values"))
    none = lambda kind: F.lit(None).cast(kind)
    if judged is None:
        rows = rows.withColumns({"place": none("int"), "grade": none("string"), "rationale": none("string")})
    else:
        rows = rows.join(judged.groupBy("system").agg(F.min(F.struct("place", "grade", "rationale")).alias("j")).select("system", "j.*"), "system", "left")
    rows = rows.withColumns({"one": F.lit(1), "last": F.col("place").isNull()})
    return running_sum(rows, [], "one", F.asc("last"), F.asc("place"), F.desc("total"), F.asc("system"), out="rank").select("rank", "system", "total", "values", "grade", "rationale")
