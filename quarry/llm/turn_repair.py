"""Conversations brought to the order ``(s?(ua)+)?`` of roles by a rank-compressed dynamic programme.

A step of the programme is a macro edit: a run of inserted turns and then the edit of one
turn. No macro's text begins another's, so edit scripts over as many turns go as their
macros do, and a state needs no script: of each layer it keeps the cost, the rank of its
script among the layer's scripts, and a pointer to the arc it came by. Scripts are read off
the pointers afterwards.

A conversation lies in order of its turns in one or more runs, one for each range of rows
that it crosses. A run is solved for every state it may be entered in; the runs of a
conversation are then chained as single steps, by the same costs and ranks. So a
conversation that holds a third of all turns is solved by many tasks.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import columns, pack
from .shared import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Macro edits in ASCII order; the number of one is its code.
MACROS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: States: nothing yet, after a system turn, a user's, an assistant's. Where s, u and a lead (-1: nowhere), and an inserted turn.
AFTER = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
INSERTED = (2, 2, 3, 2)
#: Insertions that end a conversation in each state.
CLOSING = np.array([0, 2, 1, 0])
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"
NEEDS_DELETE, IS_TRUNCATED = 2, 1
ROLES = {2: "user", 3: "assistant"}
#: Of a run of turns: faults, neighbours out of order, distinct numbers; first and last initial; whether numbered, from, to.
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "opens", "closes", "numbered", "low", "high")


def _arcs():
    """(state before, state after, code, cost by kind of turn); a kind is 3 * initial (s, u, a, another) + fault (none, truncated, to be deleted)."""
    found = []
    for before in range(4):
        at = before
        for run in range(3):
            at = INSERTED[at] if run else at
            if run == 2 and at == before:  # back where it was, for nothing
                continue
            edits = [("D", at, None), ("R", INSERTED[at], None)] + [("K", AFTER[at][i], i) for i in range(3) if AFTER[at][i] >= 0]
            for letter, after, initial in edits:
                cost = [FAR] * 12
                for kind in range(12):
                    own, fault = divmod(kind, 3)
                    if letter == "D":
                        cost[kind] = DELETE
                    elif fault < NEEDS_DELETE and (initial is None or initial == own):
                        cost[kind] = (KEEP if letter == "K" else REROLE) + fault * TRUNCATED
                found.append((before, after, MACROS.index("I" * run + letter), [c + run * INSERT for c in cost]))
    return sorted(found, key=lambda arc: arc[1])


_ARCS = _arcs()
BEFORE, TO, CODE = (np.array([arc[i] for arc in _ARCS]) for i in range(3))
COST = np.minimum(np.array([arc[3] for arc in _ARCS]).T, FAR)
_GROUPS = np.searchsorted(TO, np.arange(4))
_ARC_BITS = 6


def layers(kinds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and ranks of each run by state entered and left, and the arc into each state by turn and state entered.

    ``kinds`` are those of all runs' turns, one run after the other.
    """
    n, first = len(lengths), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at, longest = first[order], lengths[order]
    cost = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(n, 0)
    rank, parents = np.zeros((n, 4, 4), np.int64), np.empty((len(kinds), 4, 4), np.uint8)
    for layer in range(int(longest[0]) if n else 0):
        m = int(np.searchsorted(-longest, -layer))  # runs with a turn here
        turn = at[:m] + layer
        key = cost[:m][:, :, BEFORE] + COST[kinds[turn]][:, None, :]
        key = ((key * 16 + rank[:m][:, :, BEFORE]) * len(MACROS) + CODE << _ARC_BITS) + np.arange(len(CODE))
        best = np.minimum.reduceat(key, _GROUPS, axis=2)
        parents[turn] = best & ((1 << _ARC_BITS) - 1)
        script = (best >> _ARC_BITS) % (16 * len(MACROS))
        cost[:m] = np.minimum((best >> _ARC_BITS) // (16 * len(MACROS)), FAR)
        script = script.reshape(m, 16)
        rank[:m] = (script[:, None, :] < script[:, :, None]).sum(2).reshape(m, 4, 4)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return cost[back], rank[back], parents


def chained(cost: np.ndarray, rank: np.ndarray, lengths: np.ndarray):
    """Of each conversation (``lengths`` runs one after the other) the least cost, closing insertions, and each run's states entered and left."""
    n, first = len(lengths), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at, longest = first[order], lengths[order]
    total, place = np.full((n, 4), FAR), np.zeros((n, 4), np.int64)
    total[:, 0] = 0
    came = np.empty((len(cost), 4), np.int64)
    for layer in range(int(longest[0]) if n else 0):
        m = int(np.searchsorted(-longest, -layer))
        run = at[:m] + layer
        key = ((total[:m, :, None] + cost[run]) * 256 + place[:m, :, None] * 16 + rank[run]) * 4 + np.arange(4)[:, None]
        best = key.min(1)
        came[run] = best & 3
        total[:m] = np.minimum(best >> 10, FAR)
        script = best >> 2 & 255
        place[:m] = (script[:, None, :] < script[:, :, None]).sum(2)
    end_key = ((total + CLOSING * INSERT) * 4 + place) * 4 + CLOSING
    end = end_key.argmin(1)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    entered, left = np.empty(len(cost), np.int64), np.empty(len(cost), np.int64)
    state = end.copy()
    for layer in reversed(range(int(longest[0]) if n else 0)):
        m = int(np.searchsorted(-longest, -layer))
        run = at[:m] + layer
        left[run] = state[:m]
        state[:m] = entered[run] = came[run, state[:m]]
    return end_key.min(1)[back] >> 4, CLOSING[end][back], entered, left


def read_off(parents: np.ndarray, lengths: np.ndarray, entered: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The macro of each turn, from the pointers."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at, longest, enter, state = first[order], lengths[order], entered[order], left[order].copy()
    codes = np.empty(len(parents), np.uint8)
    for layer in reversed(range(int(longest[0]) if len(lengths) else 0)):
        m = int(np.searchsorted(-longest, -layer))
        arc = parents[at[:m] + layer, enter[:m], state[:m]]
        codes[at[:m] + layer] = CODE[arc]
        state[:m] = BEFORE[arc]
    return codes


def _solve(batches):
    """Runs of turns to their costs, ranks, pointers and counts."""
    for batch in batches:
        turns = batch["turns"]
        lengths = np.diff(turns.offsets.to_numpy()).astype(np.int64)
        if not len(lengths):
            continue
        values = turns.flatten()
        place, kind = (values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "kind"))
        turn_null = np.array(values.field("turn").is_null())
        turn = values.field("turn").fill_null(0).to_numpy(zero_copy_only=False)
        run = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((place, run))
        place, kind, turn, turn_null = place[order], kind[order], turn[order], turn_null[order]
        initial, fault = kind // 3, kind % 3
        blank = fault == NEEDS_DELETE
        duplicate = ~blank & ~np.isin(place, batch["firsts"].flatten().to_numpy(zero_copy_only=False))
        truncated = ~blank & ~duplicate & (fault == IS_TRUNCATED)
        cost, rank, parents = layers(initial * 3 + np.where(blank | duplicate, NEEDS_DELETE, fault), lengths)
        start = np.cumsum(lengths) - lengths
        inner = np.ones(len(run), bool)
        inner[start] = False
        before = np.r_[0, initial[:-1]]
        illegal = inner & ~_legal(before, initial)
        changed = ~turn_null & (~inner | np.r_[True, turn_null[:-1]] | (turn != np.r_[0, turn[:-1]]))
        per = lambda flags: np.bincount(run[flags], minlength=len(lengths))
        last = start + lengths - 1
        numbered = ~turn_null[last]
        low = turn[np.minimum(start + per(turn_null), last)]
        counts = [per(blank), per(duplicate), per(truncated), per(illegal), per(changed), initial[start], initial[last], numbered.astype(np.int64), low, turn[last]]
        bounds = np.r_[start, len(run)] * 16
        flat = parents.reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [batch["conv"], batch["part"], batch["head"], *[pa.array(c.astype(np.int64)) for c in counts], pa.array([pack(c) for c in cost], pa.binary()),
             pa.array([pack(r.astype(np.uint8)) for r in rank], pa.binary()), pa.array([pack(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
            ["conv", "part", "head", *_COUNTS, "cost", "rank", "parents"],
        )


def _legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """su, ua and au."""
    return (before == 0) & (after == 1) | (before == 1) & (after == 2) | (before == 2) & (after == 1)


def _chain(batches):
    """Conversations as lists of runs to their counts and the states in which each run is entered and left."""
    for batch in batches:
        runs = batch["runs"]
        lengths = np.diff(runs.offsets.to_numpy()).astype(np.int64)
        if not len(lengths):
            continue
        values = runs.flatten()
        part = values.field("part").to_numpy(zero_copy_only=False)
        conv = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((part, conv))
        number = {c: values.field(c).to_numpy(zero_copy_only=False)[order] for c in _COUNTS}
        cost, rank = (np.array([np.frombuffer(x, kind) for x in values.field(c).to_pylist()], np.int64).reshape(-1, 4, 4)[order] for c, kind in (("cost", np.int64), ("rank", np.uint8)))
        total, closing, entered, left = chained(cost, rank, lengths)
        inner = np.r_[False, conv[1:] == conv[:-1]]
        back = lambda c: np.r_[0, number[c][:-1]]
        illegal = number["illegal"] + (inner & ~_legal(back("closes"), number["opens"]))
        numbered = number["numbered"] > 0
        distinct = number["turns"] - (inner & numbered & np.r_[False, numbered[:-1]] & (back("high") == number["low"]))
        add = lambda x: np.bincount(conv, x, len(lengths)).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        span = np.zeros(len(lengths), np.int64)
        some = add(numbered) > 0
        low = number["low"][np.minimum(first + add(~numbered), len(conv) - 1)]  # unnumbered turns come first
        span[some] = (number["high"][first + lengths - 1] - low + 1 - add(distinct))[some]
        sums = [span, *[add(number[c]) for c in ("blank", "duplicate", "truncated")], add(illegal), total, closing]
        path = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (part[order], entered, left)], ["part", "entered", "left"])
        yield pa.RecordBatch.from_arrays(
            [batch["conv"], *[pa.array(x) for x in sums], pa.ListArray.from_arrays(pa.array(np.r_[first, len(conv)].astype(np.int32)), path)],
            ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "closing", "path"],
        )


def _plans(batches):
    for batch in batches:
        packed = batch["parents"].to_pylist()
        if not packed:
            continue
        lengths = np.array([len(p) // 16 for p in packed])
        codes = read_off(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 4, 4), lengths, *(batch[c].to_numpy() for c in ("entered", "left")))
        bounds = np.r_[0, np.cumsum(lengths)]
        plan = pa.array([pack(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("conv", "head", "part", "closing")], plan], ["conv", "head", "part", "closing", "plan"])


class _Writer:
    """Edits of a stream of conversations: each conversation's plans come before the texts they are for."""

    def __init__(self):
        self.conv, self.open = None, False

    def rows(self, conv, plans, closing, roles, texts):
        out = []
        for c, plan, close, role, text in zip(conv, plans, closing, roles, texts, strict=True):
            if not self.open or c != self.conv:
                self.finish(out)
                self.conv, self.open, self.state, self.step, self.left, self.close = c, True, 0, 0, deque(), 0
            if plan is not None:
                self.left.append([plan, 0])
                self.close = close
                continue
            head = self.left[0]
            macro = MACROS[head[0][head[1]]]
            head[1] += 1
            if head[1] == len(head[0]):
                self.left.popleft()
            self.insert(out, len(macro) - 1)
            edit = macro[-1]
            if edit == "D":
                text = None
            elif edit == "R":
                self.state = INSERTED[self.state]
                role = ROLES[self.state]
            else:
                self.state = AFTER[self.state]["sua".index(role[0])]
            self.put(out, edit, role, text)
        return out

    def insert(self, out, n):
        for _ in range(n):
            self.state = INSERTED[self.state]
            self.put(out, "I", ROLES[self.state], "")

    def put(self, out, edit, role, text):
        out.append((self.conv, self.step, edit, role, text))
        self.step += 1

    def finish(self, out):
        if self.open:
            self.insert(out, self.close)
            self.open = False


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation: its edits, and its counts.

    The first table has (conv, step, edit, role, text): Keep, Rerole, Delete (of the role that was, without text) and Insert (an empty
    text) in order; rows but the deleted ones are the repaired conversation. A conversation's rows stand together in order in one
    partition, so what goes through partitions need not shuffle. The second has (conv, gaps, blank, duplicate, truncated, illegal, cost).

    Turns go by number (null first), those of one number by role and then by a digest of the text; rows that are alike in all are
    each a turn, and all but the first are duplicates. Null roles and texts count as one space: such a text is blank. A null
    conversation is one. A role that begins with neither s, u nor a can't be kept. Texts are moved once, whatever their length, and one
    conversation's are streamed through one task, as its output must stand together. An empty table gives empty ones. Other columns
    are not read.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    core, initial = F.rtrim("text", F.lit(SPACES)), F.substring("role", 1, 1)
    fault = F.when(core == "", NEEDS_DELETE).when(F.right(core, F.lit(1)).isin(".", "!", "?"), 0).otherwise(IS_TRUNCATED)
    kind = F.when(initial == "s", 0).when(initial == "u", 3).when(initial == "a", 6).otherwise(9) + fault
    narrow = rows.select("conv", "turn", "role", "digest", kind.cast("byte").alias("kind"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "role", "digest", "row"]
    # rows that are alike may lie in several ranges; the upper bits of a place are its range
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed, "turns")
    firsts = placed.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"))
    none = lambda kind: F.lit(None).cast(kind)
    turn_kind, head_kind = "struct<place: bigint, turn: bigint, kind: tinyint>", "struct<turn: bigint, role: string, digest: binary>"
    part = F.shiftrightunsigned("place", 33).alias("part")
    both = placed.select("conv", part, F.struct("place", "turn", "kind").cast(turn_kind).alias("t"), F.struct("turn", "role", "digest").cast(head_kind).alias("h"), "place", none("long").alias("first"))
    both = both.unionByName(firsts.select("conv", F.shiftrightunsigned("first", 33).alias("part"), none(turn_kind).alias("t"), none(head_kind).alias("h"), none("long").alias("place"), "first"))
    runs = both.groupBy("conv", "part").agg(F.collect_list("t").alias("turns"), F.collect_list("first").alias("firsts"), F.min_by("h", "place").alias("head"))
    conv_kind = dict(rows.dtypes)["conv"]
    run_kinds = f"conv {conv_kind}, part bigint, head {head_kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, cost binary, rank binary, parents binary"
    solved = cut(runs.mapInArrow(_solve, run_kinds), "runs")
    listed = solved.groupBy("conv").agg(F.collect_list(F.struct("part", *_COUNTS, "cost", "rank")).alias("runs"))
    whole = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    chain = cut(listed.mapInArrow(_chain, f"conv {conv_kind}, {', '.join(f'{c} bigint' for c in [*whole, 'closing'])}, path array<struct<part: bigint, entered: bigint, left: bigint>>"), "chains")
    path = chain.select(F.col("conv").alias("of"), "closing", F.inline("path")).withColumnRenamed("part", "of_part")
    joined = solved.join(path, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    plans = joined.select("conv", "head", "part", "closing", "parents", "entered", "left").mapInArrow(_plans, f"conv {conv_kind}, head {head_kind}, part bigint, closing bigint, plan binary")
    plans = plans.select("conv", F.col("head.turn").alias("turn"), F.col("head.role").alias("role"), F.col("head.digest").alias("digest"), "part", "closing", "plan", none("string").alias("text"))
    texts = rows.select("conv", "turn", "role", "digest", none("long").alias("part"), none("long").alias("closing"), none("binary").alias("plan"), "text")
    # a plan stands before the first text it is for: nulls of its text go first
    stream = plans.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", F.col("part").asc_nulls_last())
    conv_type = rows.schema["conv"].dataType

    def write(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        fields = [("conv", to_arrow_type(conv_type)), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        writer = _Writer()
        for batch in batches:
            out = writer.rows(*(batch[c].to_pylist() for c in ("conv", "plan", "closing", "role", "text")))
            yield from columns(out, fields).to_batches()
        out = []
        writer.finish(out)
        yield from columns(out, fields).to_batches()

    script = stream.select("conv", "plan", "closing", "role", "text").mapInArrow(write, f"conv {conv_kind}, step bigint, edit string, role string, text string")
    return script, chain.select("conv", *whole)


def digests(script: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of a table of edits, streamed: the edits' letters, and the digest of the repaired ``role:text`` lines."""

    def read(batches):
        conv, audit, digest, some, open_ = None, [], None, False, False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv", "audit", "repaired_sha256"])
        for batch in batches:
            kind = batch["conv"].type
            for c, edit, role, text in zip(*(batch[x].to_pylist() for x in ("conv", "edit", "role", "text")), strict=True):
                if not open_ or c != conv:
                    if open_:
                        yield done()
                    conv, audit, digest, some, open_ = c, [], hashlib.sha256(), False, True
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
        if open_:
            yield done()

    return script.mapInArrow(read, f"conv {dict(script.dtypes)['conv']}, audit string, repaired_sha256 string")
