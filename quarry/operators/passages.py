"""Which of many passages stand in any of very many texts, in one scan of the texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.lineage import cut

#: Characters of the passages that one automaton holds; it takes some hundred bytes for each.
SET_CHARS = 1 << 22


def found_in_texts(items: DataFrame, texts: DataFrame, id_col: str, item: Column, text: Column, set_chars: int = SET_CHARS) -> DataFrame:
    """(id): the items whose text stands in at least one text, character by character.

    ``item`` and ``text`` are columns over the two tables, in the form to be compared. Passages are dealt to sets of ``set_chars``
    characters at most (a longer one stands alone); for each set an automaton of all its passages goes through every text once and tells each passage once a
    task, so one that every text holds costs no more than one that none does. No passage is paired with texts. Null items are found nowhere, an empty
    one is found if there is any text; items of one text are found together.
    """
    known = cut(items.select(F.col(id_col).alias("id"), item.alias("said")).where("said is not null"), "items")
    distinct = known.select("said").distinct().withColumns({"h": F.xxhash64("said"), "size": F.char_length("said").cast("long")})
    total, longest = distinct.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    # sets by hash come out near their mean; half of what one may hold leaves room for that
    n_sets = 1 + 2 * total // max(set_chars, longest)
    rows = texts.select(text.alias("text")).where("text is not null")
    found = None
    for k in range(n_sets):
        said = [r["said"] for r in distinct.where(F.pmod("h", F.lit(n_sets)) == k).select("said").collect()]
        if said:
            hits = rows.mapInArrow(_search(texts, said), "said string")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return known.select("id").where("false")
    return known.join(found.distinct(), "said", "left_semi").select("id")


def _search(frame: DataFrame, said: list[str]):
    shipped = frame.sparkSession.sparkContext.broadcast(said)  # SET_CHARS characters at most, or one passage

    def each(batches):
        automaton, left = ahocorasick.Automaton(), set()
        for n, passage in enumerate(shipped.value):
            if passage:
                automaton.add_word(passage, n)
            left.add(n)
        automaton.make_automaton()
        for batch in batches:
            new = set()
            for text in batch.column("text").to_pylist():
                new |= {n for _, n in automaton.iter(text)} if len(automaton) else set()
                if len(new) < len(left):
                    new |= {n for n in left if not shipped.value[n]}
            told = sorted(new & left)
            left -= new
            if told:
                yield pa.RecordBatch.from_arrays([pa.array([shipped.value[n] for n in told], pa.string())], ["said"])
            if not left:
                return  # all are found: this task reads no more

    return each
