import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm.queries import damaged_turns, op11_turn_repair
from quarry.llm.turn_repair import CODE, MACROS, chained, digests, layers, read_off, repair_turns

KINDS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [] if fault == 0 else [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit) of least cost and then least text, over whole scripts: a search in order of cost that keeps every text."""
    found = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}  # by last output letter
    for (_, _, role, _), fault in zip(rows, found, strict=True):
        best = inserted(best, follow)
        new = defaultdict(list)
        for last, (cost, audit) in ((k, x) for k, v in best.items() for x in v):
            new[last].append((cost + 2, audit + "D"))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in follow[last] and role:
                    new[role[0]].append((cost + more, audit + "K"))
                for letter in set(follow[last]) & {"u", "a"}:
                    new[letter].append((cost + more + 1, audit + "R"))
        # no text of as many turns begins another's, so the least of each state is enough
        best = {k: min(v) for k, v in new.items()}
    ends = inserted(best, follow)
    return min(x for last in ("", "a") for x in ends.get(last, []))


def inserted(best, follow):
    out = defaultdict(list)
    for last, (cost, audit) in best.items():
        out[last].append((cost, audit))
        for n in range(1, 4):
            last = next(x for x in follow[last] if x in "ua")
            out[last].append((cost + 5 * n, audit + "I" * n))
    return out


def repaired(rows, audit):
    kept = iter(rows)
    out = []
    n = sum(e != "D" for e in audit)
    for e in audit:
        row = None if e == "I" else next(kept)
        if e != "D":
            place = len(out) + 1 if n % 2 else len(out)
            role = row[2] if e == "K" else "user" if n % 2 == 0 and place % 2 == 0 or n % 2 and place % 2 == 0 else "assistant"
            out.append((role, "" if row is None else row[3]))
    return out


def brute(rows):
    groups = defaultdict(list)
    for c in {r[0] for r in rows}:
        groups[c] = []
    for row in damage(rows):
        groups[row[0]].append(row)
    return {c: measures(v) for c, v in groups.items()}


def measures(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found, turns = faults(rows), {r[1] for r in rows if r[1] is not None}
    cost, audit = cheapest(rows)
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    text = "\n".join(f"{r}:{t}" for r, t in repaired(rows, audit))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = of(op11_turn_repair(spark, sf_dir))
    assert got == brute(rows) and len(got) == len({r[0] for r in rows})


def test_scripts_are_least_over_all_scripts():
    """The texts themselves, all of them, against ranks: every audit up to a length is tried."""
    rng = random.Random(3)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def all_scripts(kinds):
        frontier = [("", 0, "")]
        for kind in kinds:
            own, fault = "suax"[kind // 3], kind % 3
            moved = []
            for last, cost, audit in (x for y in frontier for x in runs(y)):
                moved.append((last, cost + 2, audit + "D"))
                if fault < 2:
                    if own in follow[last]:
                        moved.append((own, cost + 5 * fault, audit + "K"))
                    moved += [(x, cost + 1 + 5 * fault, audit + "R") for x in follow[last] if x in "ua"]
            frontier = moved
        return min((cost, audit) for last, cost, audit in (x for y in frontier for x in runs(y)) if last in ("", "a"))

    def runs(state):
        last, cost, audit = state
        yield state
        for _ in range(2):
            last, cost, audit = next(x for x in follow[last] if x in "ua"), cost + 5, audit + "I"
            yield last, cost, audit

    for _ in range(60):
        kinds = [rng.randrange(12) for _ in range(rng.randrange(1, 6))]
        lengths = np.array([len(kinds)])
        cost, rank, parents = layers(np.array(kinds), lengths)
        total, closing, entered, left = chained(cost, rank, np.array([1]))
        audit = "".join(MACROS[c] for c in read_off(parents, lengths, entered, left)) + "I" * int(closing[0])
        assert (int(total[0]), audit) == all_scripts(kinds)


def test_runs_of_a_conversation_chain():
    rng = np.random.default_rng(4)
    for _ in range(40):
        kinds = rng.integers(0, 12, 60)
        kinds[rng.random(60) < 0.5] = 9  # ties by other roles
        whole = np.array([60])
        cost, rank, parents = layers(kinds, whole)
        total, closing, entered, left = chained(cost, rank, np.array([1]))
        want = [int(total[0]), int(closing[0]), *read_off(parents, whole, entered, left).tolist()]
        cuts = np.sort(rng.choice(np.arange(1, 60), 7, replace=False))
        lengths = np.diff(np.r_[0, cuts, 60])
        cost, rank, parents = layers(kinds, lengths)
        total, closing, entered, left = chained(cost, rank, np.array([len(lengths)]))
        assert [int(total[0]), int(closing[0]), *read_off(parents, lengths, entered, left).tolist()] == want


def test_codes_are_ordered_and_prefix_free():
    assert sorted(MACROS) == list(MACROS)
    assert not any(a != b and b.startswith(a) for a in MACROS for b in MACROS)
    assert set(CODE.tolist()) == set(range(9))


def random_rows(rng, n, convs):
    texts = ["Yes.", "No", "Why? ", " ", "", "\x1c.", "Ünï!", "so\x85", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "sage"]
    return [(rng.choice(convs), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_edges(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 400, [None, *range(60)]) + [(1000 + i, 1, "user", "Hi.") for i in range(40)] + [(2000, None, None, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{KINDS}, part string, conv string").repartition(5)
    script, counts = repair_turns(damaged_turns(df))
    want = {c: m for c, m in brute(rows).items()}
    kept = {c for c in want if any(r[0] == c for r in damage(rows))}
    assert of(counts) == {c: want[c][:6] for c in kept} and of(digests(script)) == {c: want[c][6:] for c in kept}


def test_all_rows_dropped(spark, tmp_path):
    ids = [i for i in range(300) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    spark.createDataFrame([(i, 0, "user", "Hi.") for i in ids], KINDS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert ids and of(op11_turn_repair(spark, str(tmp_path))) == {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in ids}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_turn_repair(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("copies", [1, 700])
def test_hot_conversation_lies_in_many_ranges(spark, copies):
    """One conversation holds most turns (and, the second time, mostly one row): several tasks share it."""
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"{i}.", f"{i}", " "])) for i in range(900)]
    rows += [(7, 450, "user", "Again and again.")] * copies + random_rows(rng, 300, range(100, 140))
    df = spark.createDataFrame(rows, KINDS).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        script, counts = repair_turns(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append((r[0], r[1], *(" " if x is None else x for x in r[2:])))
    want = {c: measures(v) for c, v in groups.items()}
    assert of(counts) == {c: m[:6] for c, m in want.items()} and of(digests(script)) == {c: m[6:] for c, m in want.items()}


def test_very_long_text(spark):
    long = "word " * 2_000_000
    df = spark.createDataFrame([(1, 0, "user", long + "."), (1, 1, "assistant", long)], KINDS)
    script, counts = repair_turns(df)
    got = {r.step: (r.edit, r.role, r.text) for r in script.where("conv = 1").collect()}
    # a deletion of both is cheaper than keeping a truncated turn
    assert "".join(got[i][0] for i in sorted(got)) == "DD" and counts.first()["cost"] == 4
