"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, digits, schemes and identifier cues.
At each anchor a parser of its kind expands to both sides as far as the kind's letters
reach, and validates what it found. A parser never looks at text that lies before the
end of its kind's last match, so matches of a kind don't overlap.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds: user and password in a URL, bank accounts named by a cue.
ADDED_KINDS = ("login", "iban")
KINDS = BASE_KINDS + ADDED_KINDS

# The patterns of the contract, entered at an anchor.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_LOGIN = re.compile(r"://([A-Za-z0-9._%+~-]+(?::[^\s/@:]+)?)@(?=[A-Za-z0-9\[])")
_IBAN = re.compile(r"[\s:=#\"'()-]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_CUES = ("iban", "IBAN", "Iban", "account", "Account", "ACCOUNT", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def iban_holds(value: str) -> bool:
    """Length and the remainder by 97 of an account number."""
    bare = value.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _machine() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue in ("@", "+", "://", *"0123456789", *_CUES):
        found.add_word(cue, (cue[0] if len(cue) == 1 else "://" if cue == "://" else "iban", len(cue)))
    found.make_automaton()
    return found


class Finder:
    """Spans (kind, start, end) of one text by code points."""

    def __init__(self):
        self.machine = _machine()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        done = dict.fromkeys(KINDS, 0)
        found: list[tuple[str, int, int]] = []
        for last, (cue, size) in self.machine.iter(text):
            at = last - size + 1
            if cue == "@":
                self.email(text, at, done, found)
            elif cue == "+":
                self.phone(text, at, done, found)
            elif cue == "://":
                self.login(text, at, done, found)
            elif cue == "iban":
                self.iban(text, last + 1, done, found)
            else:
                self.number(text, at, done, found)
        found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        return found

    def email(self, text: str, at: int, done: dict, found: list) -> None:
        start = at
        while start > done["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done["email"] = m.end()
            found.append(("email", start, m.end()))

    def phone(self, text: str, at: int, done: dict, found: list) -> None:
        if at >= done["phone"] and (m := _PHONE.match(text, at)):
            done["phone"] = m.end()
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", at, m.end()))

    def number(self, text: str, at: int, done: dict, found: list) -> None:
        if at >= done["card"] and (m := _CARD.match(text, at)):
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", at, m.end()))
        fresh = at == 0 or at == done["ip"] or text[at - 1] not in "0123456789"
        if fresh and at >= done["ip"] and (m := _IP.match(text, at)):
            done["ip"] = m.end()
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                found.append(("ip", at, m.end()))

    def login(self, text: str, at: int, done: dict, found: list) -> None:
        if (m := _LOGIN.match(text, at)) and m.start(1) >= done["login"]:
            done["login"] = m.end(1)
            found.append(("login", m.start(1), m.end(1)))

    def iban(self, text: str, after: int, done: dict, found: list) -> None:
        if (m := _IBAN.match(text, after)) and m.start(1) >= done["iban"] and iban_holds(m[1]):
            done["iban"] = m.end(1)
            found.append(("iban", m.start(1), m.end(1)))


_FINDER: list[Finder] = []


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Adds an array of (kind, start, end) by start, then kind as in KINDS; code points, end exclusive.

    Null and empty text: an empty array. All columns stay; one named ``spans_col`` is replaced.
    """
    df = df.drop(spans_col)
    schema = df.withColumn(spans_col, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches):
        if not _FINDER:
            _FINDER.append(Finder())
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in _FINDER[0].spans(t.as_py() or "")] for t in batch.column(text_col).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(item))], [*batch.schema.names, spans_col])

    return df.mapInArrow(scan, schema)


def mask_pii(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replaces each span of ``find_pii`` in the text by its kind in angle brackets; of overlapping spans the first."""
    parts = F.aggregate(
        F.col(spans_col),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1)),
    )
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, parts).otherwise(F.col(text_col)))
