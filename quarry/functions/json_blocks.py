"""JSON objects in answers, however they are wrapped or cut off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r'"(?:[^"\\]|\\.)*+(?P<closed>"?)|[{}\[\],]', re.DOTALL)
_CLOSES = {"{": "}", "[": "]"}


def _scan(text: str) -> list[str]:
    """Texts of the outermost objects. Brackets are counted outside strings, and strings within objects only: around them a quote is a quote."""
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        open_, firm, at, whole = [], [], start, True  # closing brackets due, and up to where each level is complete
        for part in _PART.finditer(text, start):
            token = part[0]
            at = part.end()
            if token[0] == '"':
                whole = bool(part["closed"])
            elif token in "{[":
                open_.append(_CLOSES[token])
                firm.append(at)
            elif token == ",":
                firm[-1] = part.start()
            elif token != open_[-1]:
                break  # brackets that don't pair: no object begins here
            else:
                open_.pop()
                firm.pop()
                if not open_:
                    break
        else:
            at = len(text)
            out.append(_mended(text[start:], "" if whole else '"', open_, [f - start for f in firm]))
            continue
        if open_:
            at = start + 1
        else:
            out.append(text[start:at])
    return [x for x in out if x is not None and _reads(x)]


def _mended(cut: str, quote: str, open_: list[str], firm: list[int]) -> str | None:
    """An object that the text's end cut off: closed as it is, else without what is unfinished of its innermost levels."""
    tails = [cut + quote + "".join(reversed(open_))]
    tails += [cut[: firm[level]] + "".join(reversed(open_[: level + 1])) for level in reversed(range(len(open_)))]
    return next((t for t in tails if _reads(t)), None)


def _reads(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


def json_objects(texts) -> Column:
    """Array of the JSON objects of a text, in order, as their own text; objects in objects aren't told apart.

    Braces in strings don't count. An object that the end cuts off is closed, without the member or element that isn't finished. What can't be read as an
    object is passed over whole, or, if its brackets don't pair, looked into for others. Null text has no array, a text without objects an empty one.
    """

    def each(column: pd.Series) -> pd.Series:
        return column.map(_scan, na_action="ignore")

    return F.when(texts.isNotNull() if isinstance(texts, Column) else F.col(texts).isNotNull(), F.pandas_udf(each, "array<string>")(texts))
