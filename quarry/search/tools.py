"""Search tools that SQL calls by name: table functions with named arguments, checked by a JSON schema before any job.

``SELECT * FROM find_text(rows => TABLE(documents), keyword => 'x', limit => 5) ORDER BY score DESC, id LIMIT 5``

A tool takes a table, adds ``score`` and ``found`` to the rows that fit and hands on the ``limit`` best of each task; the
statement around it puts these in order. Arguments are constants. A wrong one is an error of analysis: nothing has been read by then.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult

from quarry.functions.udfs import _subsequence

from .retrieval import BY_COMPOUND, BY_RATIO, COMPOUND_MOST, PHRASE_BASE

_KINDS = {"string": str, "integer": int, "number": (int, float), "array": (list, tuple), "boolean": bool}
_LIMIT = {"type": "integer", "minimum": 1, "maximum": 500, "default": 10}


def problems(arguments: dict[str, Any], schema: dict) -> list[str]:
    """What is wrong with arguments by an object's schema: unknown and missing names, types, bounds, choices, empty texts and lists."""
    own, found = schema["properties"], []
    found += [f"unknown argument {name}" for name in arguments if name not in own]
    found += [f"missing argument {name}" for name in schema.get("required", ()) if arguments.get(name) is None]
    for name, value in arguments.items():
        rule = own.get(name)
        if rule is not None and value is not None:
            found += [f"{name} {what}" for what in _broken(value, rule)]
    return found


def _broken(value: Any, rule: dict) -> list[str]:
    kind = rule["type"]
    if not isinstance(value, _KINDS[kind]) or isinstance(value, bool) != (kind == "boolean"):
        return [f"must be of type {kind}"]
    out = []
    if "enum" in rule and value not in rule["enum"]:
        out.append(f"must be one of {', '.join(map(str, rule['enum']))}")
    if value != value or "minimum" in rule and value < rule["minimum"] or "maximum" in rule and value > rule["maximum"]:
        out.append(f"must lie between {rule.get('minimum')} and {rule.get('maximum')}")
    if kind in ("string", "array") and len(value) < rule.get("minLength", rule.get("minItems", 0)):
        out.append("must not be empty")
    if kind == "array":
        out += [f"holds an item that {what}" for item in value for what in (_broken(item, rule["items"]) if item is not None else ["is null"])][:1]
    return out


@dataclass(frozen=True)
class Tool:
    """A tool's name, what it says of itself, its schema, the columns it reads with their types, and its score of a row: (score, found) or None."""

    name: str
    description: str
    properties: dict[str, dict]
    required: tuple[str, ...]
    columns: dict[str, tuple[str, ...]]
    score: Any = field(repr=False)

    @property
    def schema(self) -> dict:
        return {"type": "object", "properties": {**self.properties, "limit": _LIMIT}, "required": list(self.required)}


def _text(row, arguments):
    text, word = row["text"], arguments["keyword"]
    if text is None:
        return None
    if arguments.get("case", "exact") == "any":
        text, word = text.lower(), word.lower()
    n = text.count(word)
    at = text.find(word)
    return (float(n), row["text"][max(0, at - 20) : at + len(word) + 20]) if n else None


def _name(row, arguments):
    score = None if row["name"] is None else _subsequence(arguments["query"], row["name"])
    return None if score is None else (score, row["name"])


def _phrases(row, arguments):
    held = [p for p in dict.fromkeys(arguments["phrases"]) if row["text"] is not None and p in row["text"]]
    if not held:
        return None
    several = sum(" " in p or "_" in p for p in held)
    return round(min(1.0, PHRASE_BASE + BY_RATIO * len(held) / len(set(arguments["phrases"])) + min(several * BY_COMPOUND, COMPOUND_MOST)), 9), "|".join(held)


def _terms(row, arguments):
    asked = set(arguments["query"].lower().split())
    held = asked & set((row["text"] or "").lower().split())
    share = len(held) / max(1, len(asked))
    return (share, " ".join(sorted(held))) if held and share >= arguments.get("least", 0.0) else None


def _vector(row, arguments):
    x, y = row["embedding"], arguments["vector"]
    if x is None or len(x) != len(y) or any(v is None for v in x):
        return None
    size = math.sqrt(math.fsum(v * v for v in x) * math.fsum(v * v for v in y))
    return (round(math.fsum(a * b for a, b in zip(x, y, strict=True)) / size, 6), "") if 0 < size < math.inf else None


_SAID = {"type": "string", "minLength": 1}
TOOLS = {
    tool.name: tool
    for tool in (
        Tool("find_text", "How often a keyword stands in a text, with its surroundings.", {"keyword": _SAID, "case": {"type": "string", "enum": ["exact", "any"]}}, ("keyword",), {"text": ("string",)}, _text),
        Tool("find_name", "Names that hold a query's characters in order.", {"query": _SAID}, ("query",), {"name": ("string",)}, _name),
        Tool("find_phrases", "Texts that hold most of some phrases.", {"phrases": {"type": "array", "items": _SAID, "minItems": 1}}, ("phrases",), {"text": ("string",)}, _phrases),
        Tool("find_terms", "Texts by the share of a query's words they hold.", {"query": _SAID, "least": {"type": "number", "minimum": 0, "maximum": 1}}, ("query",), {"text": ("string",)}, _terms),
        Tool("find_vectors", "Nearest vectors by cosine.", {"vector": {"type": "array", "items": {"type": "number"}, "minItems": 1}}, ("vector",), {"embedding": ("array<float>", "array<double>")}, _vector),
    )
}


def _table_function(tool: Tool):
    class Function:
        @staticmethod
        def analyze(**arguments):
            table = arguments.pop("rows", None)
            if table is None or not table.isTable:
                raise ValueError(f"{tool.name} needs rows => TABLE(...)")
            moving = [name for name, a in arguments.items() if a.isTable or not a.isConstantExpression]
            given = {name: _plain(a.value) for name, a in arguments.items() if name not in moving}
            wrong = [f"{name} must be a constant" for name in moving] + problems(given, tool.schema)
            have = {f.name: f.dataType.simpleString() for f in table.dataType.fields}
            wrong += [f"rows need a column {c} of type {' or '.join(kinds)}" for c, kinds in tool.columns.items() if have.get(c) not in kinds]
            wrong += [f"rows have a column {c} already" for c in ("score", "found") if c in have]
            if "id" not in have:
                wrong.append("rows need a column id")
            if wrong:
                raise ValueError(f"{tool.name}: {'; '.join(wrong)}")
            return AnalyzeResult(StructType([*table.dataType.fields, StructField("score", DoubleType()), StructField("found", StringType())]))

        def __init__(self):
            self.best, self.seen, self.limit = [], 0, 0

        def eval(self, rows, **arguments):
            arguments = {k: _plain(v) for k, v in arguments.items() if v is not None}
            self.limit = arguments.get("limit", _LIMIT["default"])
            hit = tool.score(rows, arguments)
            if hit is not None:
                self.seen += 1
                # of equal scores the smaller id stays; the last number only keeps rows from being compared
                entry = (hit[0], _Reversed(rows["id"]), -self.seen, (*rows, *hit))
                (heapq.heappush if len(self.best) < self.limit else heapq.heappushpop)(self.best, entry)

        def terminate(self):
            for *_, row in self.best:
                yield row

    Function.__name__ = tool.name
    return Function


class _Reversed:
    """An id in the opposite order; null is the greatest."""

    def __init__(self, value):
        self.key = (value is None, value)

    def __eq__(self, other):
        return self.key == other.key

    def __lt__(self, other):
        return other.key[0] < self.key[0] if self.key[0] != other.key[0] else (not self.key[0] and other.key[1] < self.key[1])


def _plain(value):
    import decimal

    if isinstance(value, decimal.Decimal):
        return float(value)
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


def register(spark: SparkSession) -> None:
    """Makes all tools callable by name in the session's SQL."""
    for tool in TOOLS.values():
        spark.udtf.register(tool.name, F.udtf(_table_function(tool)))


def call(rows: DataFrame, name: str, arguments: dict[str, Any]) -> DataFrame:
    """The best rows of a tool by name, best first, ties by id. Wrong names and arguments are refused before Spark is asked."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name}; there are {', '.join(sorted(TOOLS))}")
    if wrong := problems(arguments, TOOLS[name].schema):
        raise ValueError(f"{name}: {'; '.join(wrong)}")
    register(rows.sparkSession)
    literal = lambda v: "array(" + ", ".join(map(literal, v)) + ")" if isinstance(v, list | tuple) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v).lower()
    said = "".join(f", {k} => {literal(v)}" for k, v in arguments.items() if v is not None)
    limit = arguments.get("limit", _LIMIT["default"])
    return rows.sparkSession.sql(f"SELECT * FROM {name}(rows => TABLE({{rows}}){said}) ORDER BY score DESC, id LIMIT {int(limit)}", rows=rows)
