"""Byte-level BPE by a finite-state transducer that is determinised as texts need it.

A prefix of a piece has one encoding, so its last token is fixed. The transducer reads
bytes and follows every token that may be open at once: a thread is a place in the
token trie and the token before it. At each byte one thread ends a token that fits its
predecessor, which is the prefix's last token, and starts a new one. Equal lists of
threads are one state, built once. Where all threads' beginnings go back to one place
of the piece, the tokens up to there are emitted: at the piece's end, or for long
pieces every ``WINDOW`` bytes.

All distinct pieces of some MiB of text step through the transducer together, and all
transitions that they lack at a step are determinised together, as arrays.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix, slices, text_buffer

#: The pattern whose cuts are found by classes of characters; any other goes through ``regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the vocabulary's pattern means it (the Unicode property), spelled out.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Transitions that a worker keeps (some 100 bytes each with their states), and text bytes encoded at a time.
KEEP_STEPS, STEP_BYTES = 800_000, 2 << 20
#: Pieces up to this length step together; longer ones go alone and emit at this distance.
WINDOW = 512
VOCABULARY_BYTES = 64 << 20
_NONE = np.int64(1 << 60)


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary file: a line holds a token in base 64 and its rank. Its size is checked before it is read, as each worker gets it."""
    if "://" in path:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    else:
        size = os.path.getsize(path)
    if size > VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary has {VOCABULARY_BYTES} bytes at most")
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    return {base64.b64decode(token): int(rank) for token, _, rank in (line.partition(" ") for line in lines if line)}


def merged(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The definition: merge the neighbours of lowest rank, leftmost first, until none can be merged."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Numbers:
    """Unlike 64-bit keys, numbered as they come; whole arrays are looked up at once."""

    def __init__(self, keys: np.ndarray | None = None):
        self.n = 0
        self._clear(1 << 12)
        if keys is not None:
            self.add(keys)

    def _clear(self, size: int):
        self.shift, self.slot, self.key = np.uint64(65 - size.bit_length()), np.full(size, -1, np.int32), np.zeros(size, np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _place(self, keys: np.ndarray, rows: np.ndarray):
        at, last = self._home(keys), len(self.slot) - 1
        while len(rows):
            free = self.slot[at] < 0
            self.slot[at[free]] = rows[free]  # of several that want a slot the last one stays
            won = self.slot[at] == rows
            self.key[at[won]] = keys[won]
            keys, rows, at = keys[~won], rows[~won], (at[~won] + 1) & last

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys that are new and unlike each other."""
        if 2 * (self.n + len(keys)) > len(self.slot):
            taken = np.flatnonzero(self.slot >= 0)
            old, rows, size = self.key[taken], self.slot[taken], len(self.slot)
            while 2 * (self.n + len(keys)) > size:
                size *= 2
            self._clear(size)
            self._place(old, rows)
        rows = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self._place(keys, rows)
        self.n += len(keys)
        return rows

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where there is none."""
        at, last = self._home(keys), len(self.slot) - 1
        row = self.slot[at]
        open_ = np.flatnonzero((row >= 0) & (self.key[at] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & last
            row[open_] = self.slot[at]
            again = (self.slot[at] >= 0) & (self.key[at] != keys[open_])
            open_, at = open_[again], at[again]
        return row


class Rows:
    """Rows of equal width that grow by whole arrays."""

    def __init__(self, width: int):
        self.n, self.data = 0, np.empty((width, 1024), np.int32)

    def add(self, *columns: np.ndarray):
        more = len(columns[0])
        if self.n + more > self.data.shape[1]:
            grown = np.empty((len(self.data), max(2 * self.data.shape[1], self.n + more)), np.int32)
            grown[:, : self.n] = self.data[:, : self.n]
            self.data = grown
        for own, column in zip(self.data, columns, strict=True):
            own[self.n : self.n + more] = column
        self.n += more


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """What the transducer must know of the merges, as arrays; made once on the driver."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values(), default=-1) + 1
        self.size = np.zeros(n, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.known = self.size > 0
        self.place = np.cumsum(self.size) - self.size
        at = sorted(ranks, key=ranks.__getitem__)
        self.bytes = np.frombuffer(b"".join(at), np.uint8)
        splits = [(ranks[t[:c]], ranks[t[c:]], r, len(t)) for t, r in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
        left, right, whole, size = np.array(splits, np.int64).reshape(-1, 4).T
        self.pairs = Numbers((left << 32 | right).astype(np.uint64))
        self.pair_rank = whole
        self._trie()
        self._halves(left, right, whole, size)
        #: Tokens that no merges reach: they stand for a piece only as a whole.
        self.odd = {t: r for t, r in ranks.items() if not self.reached[r]}

    def _trie(self):
        tokens = np.flatnonzero(self.known)
        node, self.trie = np.zeros(len(tokens), np.int64), Numbers()
        token, inner, depth = [np.array([-1])], [], [np.array([0])]
        for d in range(int(self.size.max(initial=0))):
            live = np.flatnonzero(self.size[tokens] > d)
            keys, back = np.unique(node[live] << 8 | self.bytes[self.place[tokens[live]] + d], return_inverse=True)
            inner.append(np.unique(node[live]))
            child = self.trie.add(keys.astype(np.uint64)).astype(np.int64) + 1
            node[live] = child[back]
            token.append(np.full(len(child), -1))
            depth.append(np.full(len(child), d + 1))
            ends = live[self.size[tokens[live]] == d + 1]
            token[-1][node[ends] - child[0]] = tokens[ends]
        self.token, self.depth = np.concatenate(token).astype(np.int32), np.concatenate(depth).astype(np.int32)
        self.inner = np.zeros(len(self.token), bool)
        self.inner[np.concatenate(inner) if inner else []] = True

    def _halves(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray, size: np.ndarray):
        """For each token the tokens at its left and right edge while it is merged, from a byte to the whole."""
        n = len(self.size)
        self.reached = self.size == 1
        self.edges, self.heights = np.full((2, n, 1), _NONE), np.zeros((2, n), np.int64)
        self.edges[:, :, 0] = np.where(self.known, np.arange(n), _NONE)
        self.heights[:] = 1
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            at = at[(np.maximum(left[at], right[at]) < whole[at]) & self.reached[left[at]] & self.reached[right[at]]]
            at = at[self.fits(left[at], right[at], whole[at])]
            made, first = np.unique(whole[at], return_index=True)
            self.reached[made] = True
            for side, half in enumerate((left[at[first]], right[at[first]])):
                high = self.heights[side, half]
                if len(high) and high.max() >= self.edges.shape[2]:
                    self.edges = np.concatenate([self.edges, np.full((2, n, 4), _NONE)], axis=2)
                self.edges[side, made] = self.edges[side, half]
                self.edges[side, made, high] = made
                self.heights[side, made] = high + 1

    def fits(self, before: np.ndarray, token: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank under ``below``) crosses from one token to the other, so that both stay; -1 before is a piece's start.

        At any moment the neighbours at the border are one token of either edge; the
        merge of least rank comes first, and of two equal ones the left.
        """
        ok = self.reached[token].copy()
        live = np.flatnonzero(ok & (before >= 0))
        b, t = before[live].astype(np.int64), token[live].astype(np.int64)
        limit = np.full(len(live), _NONE) if below is None else below[live]
        i, j = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        right, left = self.edges[1], self.edges[0]
        width = right.shape[1]
        while len(live):
            row = self.pairs.find((right[b, i] << 32 | left[t, j]).astype(np.uint64))
            across = np.where(row >= 0, self.pair_rank[row], _NONE) if len(self.pair_rank) else np.full(len(row), _NONE)
            up = np.minimum(np.where(i + 1 < width, right[b, np.minimum(i + 1, width - 1)], _NONE), limit)
            down = np.minimum(np.where(j + 1 < width, left[t, np.minimum(j + 1, width - 1)], _NONE), limit)
            crossed = (across < up) & (across <= down) & (across < limit)
            ok[live[crossed]] = False
            on = ~crossed & ((up < limit) | (down < limit))
            step = (up <= down)[on]
            live, b, t, limit, i, j = live[on], b[on], t[on], limit[on], i[on] + step, j[on] + ~step
        return ok

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of known ids, one after the other, and where each id's begin (and the last ends)."""
        size = self.size[ids]
        return self.bytes[_spread(self.place[ids], size)], np.r_[0, np.cumsum(size)]


class Transducer:
    """States and transitions as far as texts have needed them."""

    def __init__(self, vocabulary: Vocabulary | dict[bytes, int]):
        self.words = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary(vocabulary)
        self.reset()

    def reset(self):
        """Forgets all states; they are built again as they are met."""
        self.known, self.known_state = Numbers(), Rows(1)
        self.steps, self.to = Numbers(), Rows(2)  # the next state, and the last token of what has been read
        self.first, self.threads = Rows(2), Rows(2)  # of a state: first thread and number; of a thread: node and token before
        self.quick: dict[int, tuple[int, int]] = {}
        self._states(np.array([0]), np.array([-1]), np.array([1]))

    def _states(self, node: np.ndarray, before: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The states of lists of threads; new ones are stored."""
        begin = np.cumsum(counts) - counts
        turn = np.arange(len(node)) - np.repeat(begin, counts)
        thread = mix((node.astype(np.uint64) << np.uint64(32) | (before + 1).astype(np.uint64)) + turn.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        digest = mix(np.add.reduceat(thread, begin) + counts.astype(np.uint64))
        keys, index, back = np.unique(digest, return_index=True, return_inverse=True)
        row = self.known.find(keys)
        new = np.flatnonzero(row < 0)
        state = np.where(row >= 0, self.known_state.data[0][row], -1)
        state[new] = self._store(node, before, begin[index[new]], counts[index[new]])
        self.known.add(keys[new])
        self.known_state.add(state[new])
        found = state[back]
        # equal digests of unlike lists get states of their own
        own, size = self.first.data[:, found]
        same = size == counts
        at = np.flatnonzero(same)
        mine, theirs = _spread(begin[at], counts[at]), _spread(own[at], counts[at])
        unlike = (node[mine] != self.threads.data[0][theirs]) | (before[mine] != self.threads.data[1][theirs])
        same[np.repeat(at, counts[at])[unlike]] = False
        if not same.all():
            found[~same] = self._store(node, before, begin[~same], counts[~same])
        return found

    def _store(self, node: np.ndarray, before: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at, state = _spread(begin, counts), self.first.n + np.arange(len(begin))
        self.first.add(self.threads.n + np.cumsum(counts) - counts, counts)
        self.threads.add(node[at], before[at])
        return state

    def _determinise(self, keys: np.ndarray):
        """Builds transitions (state << 8 | byte) that are new and unlike each other."""
        words = self.words
        begin, counts = self.first.data[:, (keys >> np.uint64(8)).astype(np.int64)]
        who, at = np.repeat(np.arange(len(keys)), counts), _spread(begin, counts)
        node, before = self.threads.data[0][at], self.threads.data[1][at]
        child = words.trie.find(node.astype(np.uint64) << np.uint64(8) | (keys & np.uint64(255))[who]) + 1
        on = np.flatnonzero(child)
        who, child, before = who[on], child[on], before[on]
        token = words.token[child]
        ends = np.flatnonzero(token >= 0)
        ends = ends[words.fits(before[ends], token[ends])]
        owner, first = np.unique(who[ends], return_index=True)
        if len(owner) < len(keys):
            raise ValueError(f"the vocabulary lacks byte {int(keys[np.setdiff1d(np.arange(len(keys)), owner)[0]]) & 255}")
        ended = token[ends[first]]
        more = np.flatnonzero(words.inner[child])
        who = np.r_[who[more], owner]
        order = np.argsort(who, kind="stable")
        node, before = np.r_[child[more], np.zeros(len(owner), child.dtype)][order], np.r_[before[more], ended][order]
        to = self._states(node, before, np.bincount(who, minlength=len(keys)))
        self.steps.add(keys)
        self.to.add(to, ended)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """Next states and last tokens, (2, n), for keys state << 8 | byte."""
        row = self.steps.find(keys)
        lacking = np.flatnonzero(row < 0)
        if len(lacking):
            self._determinise(np.unique(keys[lacking]))
            row[lacking] = self.steps.find(keys[lacking])
        return self.to.data[:, row]

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (byte ranges of ``data``, none empty) one after the other, and how many each has."""
        if self.steps.n > KEEP_STEPS:
            self.reset()
        ids, counts = [], np.empty(len(starts), np.int64)
        long = np.flatnonzero(sizes > WINDOW)
        together = np.argsort(-sizes, kind="stable")[len(long) :]
        begin, size = starts[together], sizes[together]
        base = np.cumsum(size) - size
        last = np.empty(int(size.sum()), np.int32)
        state, still = np.zeros(len(size), np.uint64), np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for j, m in enumerate(still.tolist()):
            to, token = self.step(state[:m] << np.uint64(8) | data[begin[:m] + j])
            state[:m] = to
            last[base[:m] + j] = token
        end, left = np.zeros(len(last), bool), base + size
        low = base
        while len(left):  # all threads but the last have ended with the piece; its tokens are read from the end
            end[left - 1] = True
            left = left - self.words.size[last[left - 1]]
            on = left > low
            left, low = left[on], low[on]
        ids = last[end]
        counts[together] = np.add.reduceat(end, base, dtype=np.int64) if len(base) else 0
        back = np.cumsum(counts[together]) - counts[together]
        where = np.empty(len(starts), np.int64)
        where[together] = back
        if len(long):
            alone = [self._long(data[s : s + z].tobytes()) for s, z in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
            counts[long] = [len(a) for a in alone]
            where[long] = len(ids) + np.cumsum(counts[long]) - counts[long]
            ids = np.concatenate([ids, *alone])
        if self.words.odd:
            most = max(map(len, self.words.odd))
            for i in np.flatnonzero(sizes <= most).tolist():
                whole = self.words.odd.get(data[starts[i] : starts[i] + sizes[i]].tobytes())
                if whole is not None:
                    ids[where[i]], counts[i] = whole, 1
        return ids[_spread(where, counts)], counts

    def _long(self, piece: bytes) -> np.ndarray:
        """One long piece, byte by byte; every window emits the tokens on which all threads agree."""
        size, quick, state = self.words.size.tolist(), self.quick, 0
        out: list[np.ndarray] = []
        last: list[int] = []
        for n, byte in enumerate(piece, 1):
            found = quick.get(state << 8 | byte)
            if found is None:
                if len(quick) > KEEP_STEPS // 4:
                    quick.clear()
                to, token = self.step(np.array([state << 8 | byte], np.uint64))[:, 0].tolist()
                found = quick[state << 8 | byte] = to, token
            state = found[0]
            last.append(found[1])
            if n == len(piece) or len(last) % WINDOW == 0:
                agreed = len(last) if n == len(piece) else self._agreed(last, state)
                ids, at = [], agreed
                while at > 0:
                    ids.append(last[at - 1])
                    at -= size[ids[-1]]
                out.append(np.array(ids[::-1], np.int32))
                del last[:agreed]
        return np.concatenate(out)

    def _agreed(self, last: list[int], state: int) -> int:
        """The latest end of a token that every thread's beginning goes back to."""
        begin, count = self.first.data[:, state]
        at = {len(last) - d for d in self.words.depth[self.threads.data[0][begin : begin + count]].tolist()}
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(top - int(self.words.size[last[top - 1]]))
        return at.pop()

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_pieces(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0].tolist()


LETTER, NUMBER, OTHER, BLANK = range(4)
_CLASSES = [(regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER), (regex.compile(f"[{WHITE}]"), BLANK)]


class Cutter:
    """Cuts UTF-8 into the matches of ``PATTERN`` by the classes of characters: letters, numbers, white space and others."""

    def __init__(self):
        self.kind = np.full(0x110000, 255, np.uint8)

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        found = self.kind[codes]
        for code in np.unique(codes[found == 255]).tolist():
            self.kind[code] = next((k for p, k in _CLASSES if p.match(chr(code))), OTHER)
        return self.kind[codes]

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        out = self.kinds(np.arange(128))[np.minimum(data, 127)]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            wide = np.r_[data, np.zeros(3, np.uint8)]
            b = [wide[lead + k].astype(np.int32) for k in range(4)]
            size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
            low = [x & 63 for x in b]
            code = np.select([size == 2, size == 3], [(b[0] & 31) << 6 | low[1], (b[0] & 15) << 12 | low[1] << 6 | low[2]], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3])
            kind = self.kinds(np.minimum(code, 0x10FFFF))
            for k in range(4):
                at = (size > k) & (lead + k < len(data))
                out[lead[at] + k] = kind[at]
        return out

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin; ``offsets`` bound the texts.

        Of white space before something else the last character is a piece of its own or, if a
        space, begins the next piece; an apostrophe that begins a piece takes its ending along.
        """
        n = len(data)
        if not n:
            return np.empty(0, np.int64)
        kind = self.classes(data)
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        before, blank = np.r_[np.uint8(255), kind[:-1]], kind == BLANK
        begins = (kind != before) | head[:n]
        space = np.r_[False, data[:-1] == 0x20] & ~head[:n]
        begins &= ~(space & ~blank)
        # the last white character of a run that something follows
        turn = np.flatnonzero(~blank & np.r_[False, blank[:-1]] & ~head[:n])
        back = turn - 1
        for _ in range(2):
            back -= (data[back] & 0xC0) == 0x80
        begins[back] = True
        quote = np.flatnonzero((data == 0x27) & begins)
        if len(quote):
            wide = np.r_[data, np.zeros(2, np.uint8)]
            a, b = wide[quote + 1], wide[quote + 2]
            inside = ~head[np.minimum(quote + 1, n)]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & inside
            two = np.isin(a.astype(np.int32) << 8 | b, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")]) & inside & ~head[np.minimum(quote + 2, n)]
            for found, size in ((one, 2), (two, 3)):
                at = quote[found]
                begins[at + 1] = False
                after = at + size
                begins[after[after < n]] = True
        return np.flatnonzero(begins)


def _ranges(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Encoder:
    """Whole texts to ids: the pattern cuts pieces, the transducer encodes each distinct one."""

    def __init__(self, vocabulary: Vocabulary | dict[bytes, int], pattern: str = PATTERN):
        self.machine = Transducer(vocabulary)
        self.cutter = Cutter() if pattern == PATTERN else None
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, the pieces' bounds in them, and each text's first piece (and the end of the last)."""
        if self.cutter is not None:
            data, offsets = text_buffer(texts)
            begins = self.cutter.cut(data, offsets)
            return data, np.r_[begins, len(data)], np.searchsorted(begins, offsets)
        found = [[m.group().encode("utf-8", "surrogatepass") for m in self.pattern.finditer(t or "") if m.group()] for t in texts.to_pylist()]
        flat = [p for f in found for p in f]
        return np.frombuffer(b"".join(flat), np.uint8), np.r_[0, np.cumsum([len(p) for p in flat])].astype(np.int64), np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and the last ends)."""
        data, bounds, first = self.pieces(texts)
        if len(bounds) < 2:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        every = _ranges(data, bounds).dictionary_encode()
        own, index = text_buffer(every.dictionary), every.indices.to_numpy()
        ids, counts = self.machine.encode_pieces(own[0], own[1][:-1], np.diff(own[1]))
        begin, many = (np.cumsum(counts) - counts)[index], counts[index]
        return ids[_spread(begin, many)], np.r_[0, np.cumsum(many)][first]

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        return self.encode_texts(pa.array([text], pa.large_string()))[0].astype(np.int32).tobytes()


class Utf8Stream:
    """Text from bytes that arrive in any cuts; the state is the start of a character that hasn't ended.

    Bytes that are no UTF-8 become U+FFFD, as in one decoding of the whole.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """Length of a last character that is well formed so far but lacks bytes."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return back if back == 1 or low <= data[1 - back] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.open_tail(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def _streamed(data: np.ndarray, cuts: np.ndarray, stream_ids: int) -> str:
    """The text of one list of ids, whose bytes begin at ``cuts``, fed ``stream_ids`` ids at a time."""
    stream = Utf8Stream()
    if len(cuts) <= stream_ids + 1:
        return stream.feed(data[cuts[0] : cuts[-1]].tobytes()) + stream.close()
    ends = [*range(0, len(cuts) - 1, stream_ids), len(cuts) - 1]
    return "".join([stream.feed(data[cuts[a] : cuts[b]].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]) + stream.close()


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def bpe_encode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, text_col: str = "text", ids_col: str = "ids",
    bytes_col: str | None = None, decoded_col: str | None = None, stream_ids: int = 4096,
) -> DataFrame:
    """Adds the token ids of each text, without special tokens. Null and empty text: no ids.

    ``bytes_col`` and ``decoded_col``, if named, get what the ids decode to, as ``bpe_decode`` gives it, in the same
    pass. All columns stay; those named like an added one are replaced. Equal and repeated rows have equal
    ids; an empty table gives no rows. No shuffle. A worker holds the vocabulary's arrays, ``KEEP_STEPS``
    transitions and, for ``STEP_BYTES`` of text or one longer text, some 60 bytes for each byte of text.
    """
    extra = [c for c in (bytes_col, decoded_col) if c]
    df = df.drop(ids_col, *extra)
    vocabulary = Vocabulary(ranks)
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)
    added = {ids_col: F.lit(None).cast("array<int>")} | ({bytes_col: F.lit(None).cast("binary")} if bytes_col else {}) | ({decoded_col: F.lit(None).cast("string")} if decoded_col else {})
    schema = df.withColumns(added).schema
    key = hash(frozenset(ranks.items())), pattern

    def encode(batches):
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shipped.value, pattern)
        encoder = _ENCODERS[key]
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_string())
            for low, high in [*slices(texts, STEP_BYTES)] or [(0, 0)]:
                part = batch.slice(low, high - low)
                ids, bounds = encoder.encode_texts(texts.slice(low, high - low))
                more = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                if extra:
                    data, at = encoder.machine.words.decode(ids)
                    if bytes_col:
                        more.append(_ranges(data, at[bounds]).cast(pa.binary()))
                    if decoded_col:
                        more.append(pa.array([_streamed(data, at[a : b + 1], stream_ids) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, ids_col, *extra])

    return df.mapInArrow(encode, schema)


def bpe_decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded", text_col: str | None = None, stream_ids: int = 4096) -> DataFrame:
    """Adds the bytes of each list of ids and, if named, their text, decoded as a stream of ``stream_ids`` at a time.

    Null ids: null. An id out of the vocabulary or a null in the list: null for that row. Bytes that are no UTF-8 become
    U+FFFD in the text. All other columns stay; rows are independent, so repeated ones are alike, and an empty table gives no rows.
    """
    df = df.drop(bytes_col, *([text_col] if text_col else []))
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    added = {bytes_col: F.lit(None).cast("binary")} | ({text_col: F.lit(None).cast("string")} if text_col else {})
    schema = df.withColumns(added).schema

    def decode(batches):
        words = shipped.value
        for batch in batches:
            lists = batch.column(ids_col).cast(pa.list_(pa.int64()))
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            bounds = np.r_[0, np.cumsum(sizes)]
            inside = (flat >= 0) & (flat < len(words.size))
            inside[inside] = words.known[flat[inside]]
            wrong = np.r_[0, np.cumsum(~inside)]
            mask = ~lists.is_valid().to_numpy(zero_copy_only=False) | (wrong[bounds[1:]] > wrong[bounds[:-1]])
            data, at = words.decode(np.where(inside, flat, 0) if len(words.size) else flat[:0])
            at = at if len(words.size) else np.zeros(len(flat) + 1, np.int64)
            more = [pa.array([None if m else data[at[a] : at[b]].tobytes() for m, a, b in zip(mask.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())]
            if text_col:
                more.append(pa.array([None if m else _streamed(data, at[a : b + 1], stream_ids) for m, a, b in zip(mask.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, bytes_col, *([text_col] if text_col else [])])

    return df.mapInArrow(decode, schema)
