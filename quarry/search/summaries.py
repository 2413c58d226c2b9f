"""Summaries in Markdown as documents to search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lines and headings of a summary that are read, and the two kinds of documents.
SOURCE, ORIGINAL = "출처", "원본"
ONE_LINE, KEY_TERMS = "한 줄 설명", "핵심 용어"
KINDS = ("xlsx", "confluence")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _quoted(text: Column, name: str) -> Column:
    return _stripped(F.regexp_extract(text, rf"(?mU)^>\s*{name}:\s*(.+)$", 1))


def _key_terms(text: Column) -> Column:
    """The list below its heading: items up to the first line that is neither blank nor one."""
    lines = F.transform(F.split(F.regexp_extract(text, rf"(?U)##\s*{KEY_TERMS}\s*\n([\s\S]*)", 1), "\n"), _stripped)
    stop = F.array_position(F.transform(lines, lambda x: (x != "") & ~x.startswith("-")), F.lit(True))
    listed = F.when(stop == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0))))
    return F.filter(F.transform(listed, lambda x: _stripped(F.regexp_replace(x, "^-+", ""))), lambda x: x != "")


def _described(text: Column) -> Column:
    """The line below its heading, or else the first line of the body, cut at 200 characters."""
    line = _stripped(F.regexp_extract(text, rf"(?U)##\s*{ONE_LINE}\s*\n([^\n]+)", 1))
    body = F.filter(F.transform(F.split(text, r"\r?\n"), _stripped), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith(">"))
    return F.when(line != "", line).otherwise(F.coalesce(F.left(F.get(body, F.lit(0)), F.lit(200)), F.lit("")))


def summaries(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Documents (doc_id, kind, title, workbook, space, path, summary, key_terms, source, original, file) of summary files.

    ``path`` is relative: ``xlsx/[<number>_<category>/]<workbook>/<sheet>.md`` or ``confluence/<space>/.../<page>.md``.
    Files of other kinds, or too near the top, go; a null text is an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(F.col(path), "/")
    n, kind = F.size(parts), F.get(parts, F.lit(0))
    title = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    with_category = (n >= 4) & F.get(parts, F.lit(1)).rlike(r"^[0-9]+_")
    workbook = F.when(kind == "xlsx", F.when(with_category, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))))
    space = F.when((kind == "confluence") & (n >= 3), F.get(parts, F.lit(1)))
    tail = F.concat(F.array(F.coalesce(space, F.lit("?"))), F.when(n > 3, F.slice(parts, F.lit(3), F.greatest(n - 3, F.lit(0)))).otherwise(F.array().cast("array<string>")), F.array(title))
    shown = F.when(kind == "xlsx", F.concat_ws(" / ", F.when(with_category, F.get(parts, F.lit(1))), workbook, title)).otherwise(F.array_join(tail, " / "))
    doc_id = F.when(kind == "xlsx", F.concat_ws("::", F.lit("xlsx"), workbook, title)).otherwise(F.concat(F.lit("conf::"), F.array_join(tail, "/")))
    kept = files.where(((kind == "xlsx") & (n >= 3)) | ((kind == "confluence") & (n >= 2)))
    return kept.select(
        doc_id.alias("doc_id"), kind.alias("kind"), title.alias("title"), workbook.alias("workbook"), space.alias("space"), shown.alias("path"), _described(body).alias("summary"),
        _key_terms(body).alias("key_terms"), _quoted(body, SOURCE).alias("source"), _quoted(body, ORIGINAL).alias("original"), F.col(path).alias("file"),
    )
