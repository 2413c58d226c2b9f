"""Rules as rows: the first rule, by rank, whose pattern a path fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rule(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """``paths`` with ``rank`` and the rule's ``said`` (a map of name to value); both null where no rule fits.

    ``rules``: rank, prefix, pattern, says (map of name to template, in which ``$1`` is the pattern's first group). A path meets the rules of its own
    prefixes only, by equality: it is cut to the lengths that prefixes have, which are read first. The pattern must then fit within the path. Of rules
    of one rank the first by prefix and pattern counts; null paths fit none; each row of ``paths`` stays.
    """
    lengths = sorted(r["n"] for r in rules.select(F.char_length("prefix").alias("n")).where("n is not null").distinct().collect())
    known = rules.select("rank", "prefix", "pattern", "says").where("prefix is not null and pattern is not null")
    each = paths.select(F.col(path_col).alias("path ")).where("`path ` is not null").distinct()
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.left("path ", F.lit(n)).alias("prefix")) for n in lengths])
    met = each.select("path ", F.explode(F.filter(cuts, lambda c: F.char_length("path ") >= c["n"])).alias("c")).select("path ", "c.prefix") if lengths else each.select("path ", F.lit("").alias("prefix")).where("false")
    fits = met.join(known, "prefix").where(F.expr("`path ` RLIKE pattern"))
    best = fits.groupBy("path ").agg(F.min(F.struct("rank", "prefix", "pattern")).alias("best"))
    best = best.select("path ", "best.*").join(known, ["rank", "prefix", "pattern"]).dropDuplicates(["path "])
    whole = F.concat(F.lit(r"(?s)\A.*?(?:"), "pattern", F.lit(r").*\z"))
    said = best.select("path ", "rank", F.transform_values("says", lambda name, template: F.regexp_replace(F.col("path "), whole, template)).alias("said"))
    return paths.join(said, paths[path_col] == said["path "], "left").drop("path ")
