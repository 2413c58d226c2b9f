"""Nested page trees as rows, and converted folders as documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = "array<struct<id:string,parent:string,title:string,kind:string,version:bigint,depth:int,path:string>>"


def _nodes(manifest: str | None) -> list[dict]:
    try:
        root = json.loads(manifest or "")
    except ValueError:
        return []
    out, todo = [], [(root, None, ())] if isinstance(root, dict) else []
    while todo:
        node, parent, above = todo.pop()
        here, key = (*above, str(node.get("title") or "")), str(node.get("id"))
        kind = "folder" if node.get("type") == "folder" else "page"
        out.append({"id": key, "parent": parent, "title": here[-1], "kind": kind, "version": node.get("version") or 0, "depth": len(above), "path": "/".join(here)})
        todo.extend((c, key, here) for c in reversed(node.get("children") or []))
    return out


def nodes(manifests: DataFrame, manifest: str = "manifest") -> DataFrame:
    """``manifests`` with a row for each node of its nested JSON: place (from 0, parents before children), id, parent, title, kind, version (0 without one), depth and path.

    Text that isn't an object gives no rows. A manifest is one task's work.
    """
    found = F.udf(_nodes, _NODE, useArrow=True)(F.col(manifest))
    others = [c for c in manifests.columns if c != manifest]
    return manifests.select(*others, F.posexplode(found).alias("place", "n")).select(*others, "place", "n.*")


def versions(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, title, version): of nodes given twice the last one's."""
    return nodes.groupBy(*keys, "id").agg(F.max_by(F.struct("title", "version"), "place").alias("v")).select(*keys, "id", "v.*")


def with_piece(text: Column, after: Column, piece: Column) -> Column:
    """``text`` with a quoted piece behind its first ``after`` characters, on lines of its own."""
    rest = F.substr(text, after + 1)
    block = F.concat(F.lit("\n> "), piece, F.lit("\n"))
    return F.concat(F.left(text, after), F.when((rest != "") & ~rest.startswith("\n"), F.lit("\n")).otherwise(F.lit("")), block, rest)


def backfilled(files: DataFrame, path: str = "path", size: str = "size", name: str = "content.md") -> tuple[DataFrame, DataFrame]:
    """Documents and first conversions of converted folders: one of each for every top folder that holds a page.

    ``path`` is relative; folders whose name begins with an underscore, and pages outside a folder, are left out.
    """
    top = F.substring_index(F.col(path), "/", 1)
    pages = files.where((F.col(path).endswith(f"/{name}")) & ~top.startswith("_"))
    found = pages.groupBy(top.alias("title")).agg(F.count(F.lit(1)).alias("sheets"), F.sum(size).alias("total_size"))
    documents = found.select(F.concat("title", F.lit(".xlsx")).alias("file_path"), "title", F.lit("xlsx").alias("file_type"), F.col("total_size").alias("file_size"), F.col("sheets").alias("sheet_count"), F.lit("converted").alias("status"))
    conversions = found.select(F.concat("title", F.lit(".xlsx")).alias("file_path"), F.lit(1).alias("version"), F.lit("completed").alias("status"), F.lit(1.0).alias("quality_score"), "sheets", "total_size")
    return documents, conversions
