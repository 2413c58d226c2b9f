"""Edges, neighbourhoods and degrees."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.lineage import cut


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of each edge, each once, without loops."""
    one = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return one.union(one.select("dst", "src")).where("src <> dst").distinct()


def within(edges: DataFrame, starts: DataFrame, depth: int, start: str = "node") -> DataFrame:
    """(start, node, distance) of every node reached from each start by at most ``depth`` directed edges; starts at 0.

    A node is expanded once, from where it was first seen: each round joins the frontier only, and is written to
    the shared folder.
    """
    seen = starts.select(F.col(start).alias("start"), F.col(start).alias("node"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    hops = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    for d in range(1, depth + 1):
        reached = frontier.join(hops, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(d)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, degree) over symmetric edges; with a weight its sum as well."""
    extra = [F.sum(weight).alias("weighted_degree")] if weight else []
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), *extra)


def hubs(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(n)


#: Names that may hold one another meet by runs of so many characters at most.
RUN = 8


def _holding(small: DataFrame, large: DataFrame, inner: str, outer: str) -> DataFrame:
    """Joined rows of which ``outer`` holds ``inner``, found by the first characters of ``inner``; empty strings are held by none."""
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(outer)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.char_length(outer) - i + 1)), lambda n: F.substr(F.col(outer), i, n))))
    have = large.where(F.col(outer) != "").withColumn("run", F.explode(F.array_distinct(runs)))
    met = small.where(F.col(inner) != "").withColumn("run", F.left(inner, F.lit(RUN))).join(have, "run").drop("run")
    return met.where(F.contains(F.col(outer), F.col(inner)))


def resolve_names(refs: DataFrame, nodes: DataFrame, ref: str = "ref", node: str = "node", prefix: str = "PK_", source: str | None = None) -> DataFrame:
    """(ref, node): each reference's node by name, then without blanks, then without prefix, then by the last part of a path, else one that holds the reference or is held by it; the smallest on ties.

    With ``source``, the column of refs that names where a reference stands, gives (source, ref, node): a reference
    that names its own source has no node, and containment passes its source over.
    """
    by = ["source", "ref"] if source else ["ref"]
    forms = lambda c: [F.lower(c), F.regexp_replace(F.lower(c), r"\s+", ""), F.regexp_replace(F.lower(c), f"^{prefix.lower()}", ""), F.element_at(F.split(F.lower(c), "/"), -1)]
    keyed = lambda c, name: F.explode(F.array(*[F.struct(F.lit(i).alias(f"{name}_rank"), k.alias("key")) for i, k in enumerate(forms(c))]))
    each = refs.select(*([F.col(source).alias("source")] if source else []), F.col(ref).alias("ref")).distinct()
    known = nodes.select(F.col(node).alias("node")).distinct()
    a = each.select(*by, keyed(F.col("ref"), "r").alias("k")).select(*by, "k.*")
    b = known.select("node", keyed(F.col("node"), "n").alias("k")).select("node", "k.*")
    met = a.join(b, "key")
    first = lambda df, *order: df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("place = 1").select(*by, "node")
    named = first(met, F.col("r_rank") + F.col("n_rank"), "node")
    left = each.join(named, by, "left_anti").withColumn("r", F.lower("ref"))
    names = known.withColumn("n", F.lower("node"))
    held = _holding(left, names, "r", "n").select(*by, "node").unionByName(_holding(names, left, "n", "r").select(*by, "node"))
    if source:
        named, held = named.where("node <> source"), held.where("node <> source")
    return named.unionByName(first(held, "node"))


def extracted_edges(docs: DataFrame, system: str = "system", text: str = "text", sheets: str = "sheets", declared: str = "declared", prefix: str = "PK_") -> DataFrame:
    """(source, ref, rule), each once: what a system's text and declarations refer to.

    ``docs``: a row for each system, with its whole text, the names of its sheets and its declared references
    (arrays). Rules: ``prefix`` (names with the prefix), ``cell`` (name!A1, but not own sheets: the system of that name,
    with the prefix first, else the smallest that holds or is held), ``heading`` (all systems that a heading of level 1 to 3
    mentions, with or without prefix) and ``declared`` (the smallest other system that holds or is held, also
    without the word for system). ``ref`` is a name as found by the first rule and a system by the others.
    """
    docs = docs.select(F.col(system).alias("source"), F.col(text).alias("text"), F.col(sheets).alias("sheets"), F.col(declared).alias("declared"))
    known = docs.select(F.col("source").alias("name")).distinct().withColumn("short", F.trim(F.replace("name", F.lit(prefix), F.lit(""))))
    found = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))))

    named = docs.select("source", found(rf"({prefix}[^\s/\\,]+)").alias("ref")).withColumn("ref", F.regexp_replace(F.rtrim("ref", F.lit(")].")), "['\"]", ""))
    named = named.where((F.col("ref") != F.col("source")) & (F.char_length("ref") > 3))

    cells = docs.select("source", "sheets", found(r"(?U)(\w{2,})![A-Z]\d+").alias("said")).where((F.col("said") != F.col("source")) & ~F.coalesce(F.array_contains("sheets", F.col("said")), F.lit(False))).select("source", "said")
    equal = cells.withColumn("name", F.explode(F.array(F.concat(F.lit(prefix), "said"), F.col("said")))).join(known.select("name"), "name")
    equal = equal.groupBy("source", "said").agg(F.min_by("name", F.col("name") == F.col("said")).alias("ref"))
    rest = cells.join(equal, ["source", "said"], "left_anti")
    either = lambda rows: _holding(rows, known, "said", "short").select("source", "said", "name").unionByName(_holding(known, rows, "short", "said").select("source", "said", "name"))
    cells = equal.select("source", "ref").unionByName(either(rest).groupBy("source", "said").agg(F.min("name").alias("ref")).select("source", "ref"))

    headings = docs.select("source", found(r"(?mdU)^#{1,3}\s+(.+)$").alias("heading"))
    forms = known.where(F.char_length("name") >= 3).select("name", F.explode(F.array_distinct(F.array("name", "short"))).alias("form"))
    mentioned = _holding(forms, headings, "form", "heading").where("name <> source").select("source", F.col("name").alias("ref"))

    said = docs.select("source", F.explode("declared").alias("said")).withColumn("own", F.trim("said")).where(F.char_length("own") >= 2)
    bare = F.trim(F.replace(F.replace("own", F.lit(" 시스템"), F.lit("")), F.lit("시스템"), F.lit("")))
    said = said.select("source", "own", F.explode(F.array_distinct(F.array("own", bare))).alias("said"))
    pairs = _holding(said, known, "said", "short").select("source", "own", "name").unionByName(_holding(known, said, "short", "said").select("source", "own", "name"))
    declared_ = pairs.where("name <> source").groupBy("source", "own").agg(F.min("name").alias("ref")).select("source", "ref")

    rules = {"prefix": named, "cell": cells, "heading": mentioned, "declared": declared_}
    out = [df.select("source", "ref", F.lit(rule).alias("rule")) for rule, df in rules.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).distinct()


def related_systems(docs: DataFrame, system: str = "system", **columns: str) -> DataFrame:
    """(src, dst), in both directions: the systems that ``extracted_edges`` leads to once their names are resolved."""
    found = resolve_names(extracted_edges(docs, system, **columns), docs, node=system, source="source")
    return symmetric(found, "source", "node")


def paths_to_root(nodes: DataFrame, id_col: str, parent: str, name: str, most: int | None = None) -> DataFrame:
    """(id, path): names from the root down, joined by slashes. Nodes whose parents come round again have none; ``most`` bounds the depth if given."""
    up = nodes.select(F.col(id_col).alias("id"), F.col(parent).alias("at"), F.col(name).alias("path"), F.array(F.col(id_col)).alias("seen"))
    parents = nodes.select(F.col(id_col).alias("at"), F.col(parent).alias("above"), F.col(name).alias("its"))
    done = up.where("at is null")
    for _ in itertools.count() if most is None else range(most):
        up = cut(up.where("at is not null and not array_contains(seen, at)").join(parents, "at", "left").select("id", F.col("above").alias("at"), F.when(F.col("its").isNull(), F.col("path")).otherwise(F.concat_ws("/", "its", "path")).alias("path"), F.array_append("seen", F.col("at")).alias("seen")), "path")
        done = done.unionByName(up.where("at is null"))
        if up.where("at is not null").limit(1).count() == 0:
            break
    return done.select("id", "path")


def greedy_clusters(edges: DataFrame, n: int, size: int = 3) -> DataFrame:
    """(rank, nodes) of up to ``n`` clusters of 2 to ``size`` unused neighbours, from the node of greatest degree (then least name) down.

    A node is settled by those before it within two steps alone. So in each round every node that comes first within two
    steps of what is still free takes its first neighbours; used nodes and their edges go, and a node left without free
    neighbours is in no cluster. ``edges`` are symmetric; loops and null ends are left out. Each round is a table.
    """
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    order = pairs.groupBy("src").agg((-F.count(F.lit(1))).alias("turn")).select(F.col("src").alias("node"), F.struct("turn", F.col("src").alias("name")).alias("at"))
    left = cut(pairs.join(order.select(F.col("node").alias("src"), F.col("at").alias("a")), "src").join(order.select(F.col("node").alias("dst"), F.col("at").alias("b")), "dst").select("a", "b"), "free")
    found = []
    while not left.isEmpty():
        near = left.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("near"))
        two = left.join(near.select(F.col("a").alias("b"), "near"), "b").groupBy("a").agg(F.min("near").alias("least"))
        heads = two.where("a <= least").select(F.col("a").alias("head"))
        taken = left.join(heads, F.col("a") == F.col("head")).withColumn("place", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("place") < size)
        taken = cut(taken.select("head", "place", F.col("b").alias("node")), "clusters")
        found.append(taken)
        used = taken.select("node").unionByName(taken.select(F.col("head").alias("node"))).distinct()
        for end in ("a", "b"):
            left = left.join(used, left[end] == used["node"], "left_anti")
        left = cut(left, "free")
    if not found:
        return left.select(F.lit(0).alias("rank"), F.array(F.col("a.name")).alias("nodes"))
    members = reduce(DataFrame.unionByName, found).groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", F.col("node.name").alias("name")))).alias("rest"))
    first = members.orderBy("head").limit(n)
    rank = F.row_number().over(W.orderBy("head"))
    return first.select(rank.alias("rank"), F.concat(F.array("head.name"), F.transform("rest", lambda r: r["name"])).alias("nodes"))


def edge_evidence(conflicts: DataFrame) -> DataFrame:
    """(pair_id, side, system, topic, type, severity, says) of nested conflict reports: both sides of each conflict that say something.

    ``conflicts``: pair_id, left, right, conflicts array<struct<type,topic,severity,left_says,right_says>>.
    """
    each = conflicts.select("pair_id", "left", "right", F.explode("conflicts").alias("c"))
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("system"), F.col("c.left_says").alias("says")), F.struct(F.lit("right").alias("side"), F.col("right").alias("system"), F.col("c.right_says").alias("says"))))
    out = each.select("pair_id", F.col("c.topic").alias("topic"), F.col("c.type").alias("type"), F.col("c.severity").alias("severity"), sides.alias("s"))
    return out.select("pair_id", "s.side", "s.system", "topic", "type", "severity", "s.says").where("trim(coalesce(says, '')) <> ''")


# Severities from the worst on.
SEVERITIES = ("critical", "major", "minor")


def paired_topics(evidence: DataFrame) -> DataFrame:
    """(pair_id, type, topic, severity, rank) of the conflicts about which both sides say something, each with its worst severity.

    ``rank`` is the severity's place from the worst on (unknown ones last); order by it for a list.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)), F.lit(len(SEVERITIES) + 1)).cast("int")
    found = evidence.withColumn("rank", rank).groupBy("pair_id", "type", "topic").agg(F.count_distinct("side").alias("sides"), F.min(F.struct("rank", "severity")).alias("s"))
    return found.where("sides = 2").select("pair_id", "type", "topic", "s.severity", "s.rank")


def united(*sources: DataFrame, key: str = "name") -> DataFrame:
    """Rows of several sources of systems, each system once: a value is that of the first source that has one.

    Sources may lack columns of one another. Rows without a key are left out; of rows of one source with one key the least values count.
    """
    names = list(dict.fromkeys(c for df in sources for c in df.columns if c != key))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source ", F.lit(i)) for i, df in enumerate(sources)]).where(F.col(key).isNotNull())
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("source ", F.col(c).alias("value"))))["value"].alias(c)
    return rows.groupBy(key).agg(*[first(c) for c in names])


def edges_with_attributes(nodes: DataFrame, name: str = "name", related: str = "related", attributes: tuple[str, ...] = ("description", "sheet_count")) -> DataFrame:
    """(source, target, the target's attributes, raw_degree): each reference of a node's list, repeated ones as often as they stand, also to nodes that aren't there."""
    edges = nodes.select(F.col(name).alias("source"), F.size(F.coalesce(related, F.array())).alias("raw_degree"), F.explode(related).alias("target"))
    return edges.join(nodes.select(F.col(name).alias("target"), *attributes).dropDuplicates(["target"]), "target", "left").select("source", "target", *attributes, "raw_degree")
