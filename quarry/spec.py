"""A query said as a dictionary, checked against the tables' columns and turned into a frame.

``{"table": .., "columns": [..], "joins": [{"table": .., "on": [left, right]}], "filters":
[{"column": .., "op": .., "value": ..}], "aggregation": {"group_by": [..], "measures":
[{"func": .., "column": .., "alias": ..}]}, "order_by": [{"column": .., "direction": ..}], "limit": ..}``

Columns are named alone or as ``table.column``; alone, the base table's goes first, then that of the one joined
table that has it.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SpecError

MAX_ROWS, DEFAULT_ROWS = 500, 100
_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
OPS = (*_COMPARE, "LIKE", "IN", "IS NULL", "IS NOT NULL")
MEASURES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


@dataclass
class Query:
    table: str
    columns: list[str] = field(default_factory=lambda: ["*"])
    joins: list[dict] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)
    aggregation: dict | None = None
    order_by: list[dict] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0

    @classmethod
    def of(cls, spec: dict) -> Query:
        unknown = set(spec) - {"action", *cls.__dataclass_fields__}
        if unknown or not spec.get("table"):
            raise SpecError(f"unknown parts: {sorted(unknown)}" if unknown else "a table is needed")
        return cls(**{k: v for k, v in spec.items() if k != "action" and v is not None})


class _Scope:
    """Columns in reach, by their names."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables, self.frames = tables, {}

    def add(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise SpecError(f"no table {table!r}")
        if table in self.frames:
            raise SpecError(f"table {table!r} twice")
        self.frames[table] = self.tables[table].select([F.col(f"`{c}`").alias(f"{table}.{c}", metadata=self.tables[table].schema[c].metadata) for c in self.tables[table].columns])
        return self.frames[table]

    def find(self, name: str) -> str:
        table, _, column = name.rpartition(".")
        inside = [table] if table else list(self.frames)
        owners = [t for t in inside if t in self.frames and column in self.tables[t].columns]
        if not owners:
            raise SpecError(f"no column {name!r}")
        if not table and len(owners) > 1 and owners[0] != next(iter(self.frames)):
            raise SpecError(f"column {name!r} is in {owners}")
        return f"{owners[0]}.{column}"

    def column(self, name: str) -> Column:
        return F.col(f"`{self.find(name)}`")

    def type(self, name: str) -> T.DataType:
        table, _, column = self.find(name).rpartition(".")
        return self.tables[table].schema[column].dataType


def predicate(column: Column, kind: T.DataType, op: str, value=None) -> Column:
    """One condition. A value that can't be read as the column's type matches nothing."""
    op = op.upper()
    fit = lambda v: F.lit(v if isinstance(v, str | None) else str(v)).try_cast(kind)
    if op == "IS NULL":
        return column.isNull()
    if op == "IS NOT NULL":
        return column.isNotNull()
    if op == "IN":
        values = value if isinstance(value, list | tuple) else [value]
        return column.isin([fit(v) for v in values]) if values else F.lit(False)
    if op == "LIKE":
        return column.cast("string").ilike(str(value).replace("\\", "\\\\"))
    if op not in _COMPARE:
        raise SpecError(f"no operator {op!r}; there are {', '.join(OPS)}")
    return _COMPARE[op](column, fit(value))


def unlimited(spec: dict | Query, tables: dict[str, DataFrame]) -> DataFrame:
    """All matching rows, ordered."""
    query = spec if isinstance(spec, Query) else Query.of(spec)
    scope = _Scope(tables)
    df = scope.add(query.table)
    for join in query.joins:
        on = join.get("on")
        if not on or len(on) != 2:
            raise SpecError("a join is on two columns")
        other = scope.add(join["table"])
        base_side, other_side = sorted(on, key=lambda c: scope.find(c).startswith(f"{join['table']}."))
        df = df.join(other, scope.column(base_side) == scope.column(other_side))
    for f in query.filters:
        df = df.where(predicate(scope.column(f["column"]), scope.type(f["column"]), f["op"], f.get("value")))
    if query.aggregation is not None:
        keys = query.aggregation.get("group_by") or []
        outputs = [_measure(m, scope) for m in query.aggregation.get("measures") or []]
        if not outputs and not keys:
            raise SpecError("an aggregation needs measures or groups")
        names = [k.rpartition(".")[2] for k in keys]
        groups = df.groupBy(*[scope.column(k).alias(n) for k, n in zip(keys, names, strict=True)])
        df = groups.agg(*outputs) if outputs else groups.count().drop("count")
        order = {**dict(zip(keys, names, strict=True)), **{n: n for n in df.columns}}
    else:
        chosen = [c for name in query.columns for c in ([x for f in scope.frames.values() for x in f.columns] if name == "*" else [scope.find(name)])]
        short = [c.rpartition(".")[2] for c in chosen]
        names = [c if short.count(s) > 1 else s for c, s in zip(chosen, short, strict=True)]
        order = None
    for o in query.order_by:
        if order is not None and o["column"] not in order:
            raise SpecError(f"no column {o['column']!r} in the result")
    by = [(F.col(f"`{order[o['column']]}`") if order is not None else scope.column(o["column"])) for o in query.order_by]
    by = [c.desc_nulls_last() if str(o.get("direction", "ASC")).upper() == "DESC" else c.asc_nulls_first() for c, o in zip(by, query.order_by, strict=True)]
    df = df.orderBy(*by) if by else df
    return df if order is not None else df.select([F.col(f"`{c}`").alias(n) for c, n in zip(chosen, names, strict=True)])


def _measure(measure: dict, scope: _Scope) -> Column:
    func, column = str(measure.get("func", "")).upper(), measure.get("column", "*")
    if func not in MEASURES or (column == "*" and func != "COUNT"):
        raise SpecError(f"no measure {func}({column})")
    value = MEASURES[func](F.lit(1) if column == "*" else scope.column(column))
    return value.alias(measure.get("alias") or f"{func}_{column.replace('*', 'all').replace('.', '_')}")


def row_limit(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_ROWS
    if limit < 0:
        raise SpecError("a limit can't be negative")
    return min(limit, MAX_ROWS)


def run(spec: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """The page of rows that the spec asks for, 100 by default and 500 at most."""
    query = Query.of(spec)
    df = unlimited(query, tables)
    return (df.offset(query.offset) if query.offset else df).limit(row_limit(query.limit))


def total_matched(spec: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows match, whatever the limit."""
    return unlimited({**spec, "order_by": []}, tables).agg(F.count(F.lit(1)).alias("total_matched"))


def filters_of(text: str) -> list[dict]:
    """``a>=1,b=2`` as a list of filters."""
    out = []
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        m = re.match(r"([^<>=!]+)(>=|<=|!=|=|>|<)(.*)$", part)
        if not m:
            raise SpecError(f"no condition: {part!r}")
        out.append({"column": m[1].strip(), "op": m[2], "value": m[3].strip()})
    return out


def any_of(columns: dict[str, Column], given: dict) -> Column:
    """All of the given conditions that aren't None: lists, and text with commas, by membership, the rest by equality."""
    parts = []
    for k, v in given.items():
        if isinstance(v, str) and "," in v:
            v = [x.strip() for x in v.split(",") if x.strip()]
        if v is not None:
            parts.append(columns[k].isin(list(v)) if isinstance(v, list | tuple | set) else columns[k] == v)
    return reduce(operator.and_, parts, F.lit(True))


def found_in(word: str, *columns: str) -> Column:
    """Whether any of the columns holds the word, in either case; null columns hold nothing."""
    return reduce(operator.or_, (F.coalesce(F.lower(c).contains(word.lower()), F.lit(False)) for c in columns))


def execute(request: dict, tables: dict[str, DataFrame], catalog: DataFrame, enums: DataFrame) -> DataFrame:
    """Any action: query, list_tables, describe or lookup_enum."""
    from . import catalog as facts

    action = request.get("action", "query")
    match action:
        case "query":
            return run(request, tables)
        case "list_tables":
            return facts.list_tables(catalog)
        case "describe":
            if request.get("table") not in tables:
                raise SpecError(f"no table {request.get('table')!r}")
            return facts.describe(catalog, request["table"])
        case "lookup_enum":
            name = request.get("enum_type") or request.get("enum_name") or request.get("table")
            if not name:
                raise SpecError("an enumeration is needed")
            return facts.lookup_enum(enums, name)
    raise SpecError(f"no action {action!r}")


def markdown_table(df: DataFrame, rows: int = 50, width: int = 60) -> DataFrame:
    """The first rows as lines of a Markdown table (column ``line``); long cells are cut."""
    cell = lambda c: F.coalesce(F.when(F.length(c.cast("string")) > width, F.concat(F.left(c.cast("string"), F.lit(width - 3)), F.lit("..."))).otherwise(c.cast("string")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f"`{c}`")) for c in df.columns]), F.lit(" |"))
    return df.limit(rows).select(line.alias("line"))
