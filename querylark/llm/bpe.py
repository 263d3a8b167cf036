"""Byte-level BPE without a regex engine.

Pre-tokenisation: each code point gets a class from an array; a class is a function from automaton states to states, the
functions are closed under composition (a small monoid with a multiplication table), so prefixes of the text are combined by
an associative scan: within blocks side by side, over the block totals by doubling, then every state is known at once and
token boundaries are read from a table. The slices feed a pair merger with a bounded two-generation cache; new pieces of a chunk
are merged together in numpy, very long ones by a heap. Byte offsets of tokens are kept and place the bytes in decoding.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from querylark.llm.common import _C1, _C2, _HEAD, CHUNK_BYTES, narrow, per_chunk, pieces, small_arrow_batches, texts

# states of the automaton
START, LETTER, NUMBER, OTHER, SPACES, PENDING, CON1, CON2 = range(8)
# classes: letter, number, other, apostrophe of a contraction of 2 and of 3, white space that is followed by more of it (or by
# nothing), the last space of a run before something else, the last of other white space; with START_FLAG where a text starts
C_L, C_N, C_O, C_A2, C_A3, C_W, C_S, C_V = range(8)
START_FLAG = 8
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE_CLASS = "".join(f"\\U{c:08x}" for c in _WHITE)
_GAP = re.compile(f"(?<=[^{_SPACE_CLASS}])[{_SPACE_CLASS}]")
PART = CHUNK_BYTES
#: The table of short pieces has two to this power slots; a new piece takes the slot of an older one.
SLOT_BITS = 18
_CONTRACTIONS = {"s": 2, "t": 2, "m": 2, "d": 2, "re": 3, "ve": 3, "ll": 3}


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point; white space counts as C_W until its neighbour is seen."""
    table = np.full(0x110000, C_O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = C_L
        elif k == "N":
            table[c] = C_N
    table[_WHITE] = C_W
    return table


def _step(c: int, s: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character."""
    if c >= START_FLAG:
        c, s = c - START_FLAG, START
    if s in (CON1, CON2):
        return s - 1 if s == CON2 else START, False
    if s == PENDING and c < C_W:
        return (LETTER, NUMBER, OTHER, OTHER, OTHER)[c], False
    if (s, c) in ((LETTER, C_L), (NUMBER, C_N), (SPACES, C_W)) or s == OTHER and c in (C_O, C_A2, C_A3):
        return s, False
    return (LETTER, NUMBER, OTHER, CON1, CON2, SPACES, PENDING, START)[c], True


@functools.cache
def monoid() -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Multiplication table (entries and row numbers times the size), its size, states after each function, and boundaries by
    class and state. Elements 0..15 are the classes, 16 the identity."""
    elements = [tuple(_step(c, s)[0] for s in range(8)) for c in range(16)] + [tuple(range(8))]
    index: dict[tuple, int] = {}
    for i, f in enumerate(elements):
        index.setdefault(f, i)
    at = 0
    while at < len(elements):
        for c in range(16):
            g = tuple(elements[c][s] for s in elements[at])
            if g not in index:
                index[g] = len(elements)
                elements.append(g)
        at += 1
    m = len(elements)
    fn = np.array(elements)
    mul = np.array([[index[tuple(fn[b][fn[a]])] for b in range(m)] for a in range(m)], np.intp) * m
    starts = np.array([[_step(c, s)[1] for s in range(8)] for c in range(16)])
    return mul.ravel(), m, fn.ravel().astype(np.intp), starts.ravel()


def boundaries(cp: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions where tokens start in the code points of several texts on end; begins: where a text that isn't empty starts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    mul, m, fn, starts = monoid()
    cls = class_table()[cp]
    is_begin = np.zeros(n + 1, bool)
    is_begin[begins] = True
    is_begin[n] = True
    white = cls == C_W
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[-1] = False
    last &= ~is_begin[1:]
    at = np.flatnonzero(last)
    cls[at] = np.where(cp[at] == 0x20, C_S, C_V)
    for i in np.flatnonzero(cp == 0x27).tolist():
        if not is_begin[i + 1]:
            a = chr(cp[i + 1])
            size = _CONTRACTIONS.get(a, 0) or (0 if is_begin[i + 2] else _CONTRACTIONS.get(a + chr(cp[i + 2]), 0))
            if size:
                cls[i] = C_A2 if size == 2 else C_A3
    cls[begins] += START_FLAG
    # blocks side by side
    length = 128
    width = -(-n // length)
    grid = np.full(length * width, 16, np.intp)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(width, length).T)
    seen = np.empty((length, width), np.intp)
    acc = seen[0] = grid[0] * m
    for j in range(1, length):
        np.take(mul, acc + grid[j], out=seen[j])
        acc = seen[j]
    # block totals by doubling
    total, d = acc.copy(), 1
    while d < width:
        total[d:] = mul[total[:-d] + total[d:] // m]
        d *= 2
    entry = np.full(width, START, np.intp)
    entry[1:] = fn[total[:-1] // m * 8 + START]
    before = np.empty((length, width), np.intp)
    before[0] = entry
    before[1:] = fn[seen[:-1] // m * 8 + entry]
    found = starts[np.minimum(grid, 15) * 8 + before]
    return np.flatnonzero(found.T.ravel()[:n])


class Vocabulary:
    """Pairs of ids, their ranks and what they become; bytes of each id; bounded cache of pieces."""

    GENERATION = 150_000

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                whole = json.load(f)
            model, added = whole["model"], {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
            back = {c: b for b, c in _byte_characters().items()}
            vocab = model["vocab"]
            self.tokens = [b""] * (max(*vocab.values(), *added.values()) + 1)
            for t, i in vocab.items():
                self.tokens[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
            for t, i in added.items():
                self.tokens[i] = t.encode()
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            table = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
            self.whole: dict[bytes, int] = {}
        else:
            added = {}
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.tokens = [b""] * (max(ranks.values()) + 1)
            for t, i in ranks.items():
                self.tokens[i] = t
            table = {}
            for t, i in ranks.items():
                for k in range(1, len(t)):
                    a, b = ranks.get(t[:k]), ranks.get(t[k:])
                    if a is not None and b is not None:
                        table[a, b] = (i, i)
            self.whole = ranks  # a piece that is a token is that token
        #: Tokens beside the model, which stand in texts as they are; matched before pre-tokenisation, leftmost and longest first.
        self.added = added
        self.split_at = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.table = table
        keys = np.array([a << 20 | b for a, b in table], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        value = np.array(list(table.values()), np.int64).reshape(-1, 2)[order]
        self.rank, self.new = value[:, 0].copy(), value[:, 1].copy()
        single = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.byte = np.array([single[bytes([b])] for b in range(256)], np.int64)
        a = np.repeat(self.byte, 256)
        self.first_rank, self.first_new = (x.reshape(256, 256) for x in self.lookup(a, np.tile(self.byte, 256)))
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(self.tokens), np.uint8)
        # slots of short pieces: bytes (the length in the last one), number of ids, 16 places for ids; behind them, those of a chunk's other pieces
        self.low, self.high = (np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(2))
        self.count = np.zeros(1 << SLOT_BITS, np.uint8)
        self.pool = np.zeros((16 << SLOT_BITS) + CHUNK_BYTES, "<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    NONE = np.int64(1 << 40)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], self.NONE), self.new[at]

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece, by a heap over a linked list: n log n."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, table = len(ids), self.table
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*table[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in table]
        heap = [(r, i, new, p) for r, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, p = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
                if (q := (new, ids[after[i]])) in table:
                    heapq.heappush(heap, (table[q][0], i, table[q][1], q))
            if prior[i] >= 0 and (q := (ids[prior[i]], new)) in table:
                heapq.heappush(heap, (table[q][0], prior[i], table[q][1], q))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers. In each round every piece merges its leftmost pair of
        the lowest rank."""
        out: list[bytes] = [b""] * len(pieces)
        todo: list[int] = []
        whole = self.whole
        for i, p in enumerate(pieces):
            if (t := whole.get(p)) is not None:
                out[i] = t.to_bytes(4, "little")
            elif len(p) > 48:
                out[i] = np.array(self.merge_long(p), "<u4").tobytes()
            else:
                todo.append(i)
        if not todo:
            return out
        raw = np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)
        size = np.array([len(pieces[i]) for i in todo])
        word = np.repeat(np.arange(len(todo)), size)
        ids = self.byte[raw]
        rank = np.full(len(raw), self.NONE)
        new = np.zeros(len(raw), np.int64)
        same = word[1:] == word[:-1]
        rank[:-1] = np.where(same, self.first_rank[raw[:-1], raw[1:]], self.NONE)
        new[:-1] = self.first_new[raw[:-1], raw[1:]]
        done_w, done_i = [], []
        while len(ids):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(ids)))
            live = least < self.NONE
            each = np.repeat(live, sizes)
            if not live.all():
                done_w.append(word[~each])
                done_i.append(ids[~each])
                word, ids, rank, new = word[each], ids[each], rank[each], new[each]
                least, sizes = least[live], sizes[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            w = word[at]
            at = at[np.concatenate(([True], w[1:] != w[:-1]))]
            ids[at] = new[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            word, ids, rank, new = word[keep], ids[keep], rank[keep], new[keep]
            at -= np.arange(len(at))
            redo = np.concatenate((at, at[at > 0] - 1))
            redo_next = np.minimum(redo + 1, len(ids) - 1)
            r, v = self.lookup(ids[redo], ids[redo_next])
            rank[redo] = np.where((redo < len(ids) - 1) & (word[redo] == word[redo_next]), r, self.NONE)
            new[redo] = v
        word, ids = np.concatenate(done_w), np.concatenate(done_i)
        order = np.argsort(word, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        to = np.cumsum(np.bincount(word, minlength=len(todo))) * 4
        a = 0
        for i, b in zip(todo, to.tolist()):
            out[i] = data[a:b]
            a = b
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        got = [young.get(p) for p in pieces]
        missing = [p for p, v in zip(pieces, got) if v is None]
        if missing:
            new = []
            for p in missing:
                if (v := old.get(p)) is not None:
                    young[p] = v
                else:
                    new.append(p)
            if new:
                young.update(zip(new, self.merge_many([p.encode() for p in new])))
            got = [young[p] if v is None else v for p, v in zip(pieces, got)]
        if len(young) > self.GENERATION:
            self.old, self.young = young, {}
        return got

    def encode(self, many: list[str]) -> list[np.ndarray]:
        """Ids of each text (unsigned 32-bit). Texts beyond PART code points go in parts that begin at white space after something
        else, where a piece always begins; so memory follows the part, or the longest run without white space."""
        if not any(len(t) > PART for t in many):
            return self.encode_parts(many)
        out = []
        for t in many:
            parts = [x for p in pieces(t, _GAP, PART) for x in self.encode_parts([p])]
            out.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
        return out

    def encode_parts(self, many: list[str]) -> list[np.ndarray]:
        """Ids of each text. Pieces of up to 15 bytes are looked up side by side in a table of slots, where their bytes and length are
        compared, in two integers; those that aren't there, and longer ones, by the dictionary. So no hash is trusted."""
        joined = "".join(many)
        ends = np.cumsum([len(t) for t in many])
        begins = np.concatenate(([0], ends[:-1]))
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = boundaries(cp, begins[ends > begins])
        if not len(starts):
            return [np.zeros(0, "<u4")] * len(many)
        stops = np.append(starts[1:], len(cp))
        raw = joined.encode()
        if len(raw) == len(cp):
            at = starts
        else:
            at = np.concatenate(([0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))))[starts]
        length = np.diff(np.append(at, len(raw)))
        lanes = np.ndarray(len(raw) + 9, "<u8", raw + bytes(16), 0, (1,))
        short = length < 16
        size = np.minimum(length, 15)
        low = lanes[at] & _HEAD[np.minimum(size, 8)]
        high = lanes[np.minimum(at + 8, len(raw))] & _HEAD[np.maximum(size - 8, 0)] | size.astype(np.uint64) << np.uint64(56)
        with np.errstate(over="ignore"):
            h = low * _C1 ^ high * _C2
            h = (h ^ h >> np.uint64(32)) * _C1
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.intp)
        known = short & (self.low[slot] == low) & (self.high[slot] == high)
        count, begin = self.count[slot].astype(np.int64), slot * 16
        new = np.flatnonzero(~known)
        index: dict[str, int] = {}
        number = np.array([index.setdefault(joined[a:b], len(index)) for a, b in zip(starts[new].tolist(), stops[new].tolist())], np.int64)
        got = self.encode_pieces(list(index))
        flat = np.frombuffer(b"".join(got), "<u4")
        size = np.array([len(x) for x in got], np.int64) >> 2
        place = np.cumsum(size) - size
        pool, slots = self.pool, 16 << SLOT_BITS
        if len(flat) > len(pool) - slots:  # not kept
            pool = np.concatenate((pool[:slots], flat))
        pool[slots : slots + len(flat)] = flat
        count[new], begin[new] = size[number], place[number] + slots
        to = np.cumsum(count)
        where = np.repeat(begin - (to - count), count)
        where += np.arange(len(where))
        ids = pool[where]
        # the pieces that were new take their slots: each the first place where it stood, one a slot
        first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
        first = first[short[new[first]]]
        own, one = np.unique(slot[new[first]], return_index=True)
        first = first[one]
        self.low[own], self.high[own], n = low[new[first]], high[new[first]], size[number[first]]
        self.count[own] = n
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.pool[np.repeat(own * 16, n) + step] = flat[np.repeat(place[number[first]], n) + step]
        cut = np.concatenate(([0], to))[np.searchsorted(starts, np.append(begins, len(cp)))].tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def encode_with_added(self, many: list[str]) -> list[np.ndarray]:
        """encode() between the file's added tokens, which get their own ids: what the tokenizers library does by default."""
        if self.split_at is None:
            return self.encode(many)
        parts = [self.split_at.split(t) for t in many]  # every second one is an added token
        ids = iter(self.encode([x for p in parts for x in p[::2]]))
        out = []
        for p in parts:
            one = [next(ids)]
            for t in p[1::2]:
                one += [np.array([self.added[t]], "<u4"), next(ids)]
            out.append(np.concatenate(one) if len(one) > 1 else one[0])
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text, and the text's length at the end."""
        return np.concatenate(([0], np.cumsum(self.size[ids])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the ids, put where the offsets say, PART ids at a time."""
        out = []
        for a in range(0, len(ids), PART):
            some, to = ids[a : a + PART], offsets[a : a + PART + 1]
            where = np.repeat(self.place[some] - (to[:-1] - to[0]), np.diff(to))
            where += np.arange(len(where))
            out.append(self.all[where].tobytes())
        return b"".join(out)


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in JSON vocabularies of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and offsets (binary: little-endian unsigned 32-bit integers; offsets are byte offsets, one more than ids).

    A null text is the empty text: no ids, offsets [0]. Null and repeated doc_ids are carried as they are; any length of text is
    handled whole; other columns are left out. An empty table gives an empty table."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary())])

    def run(part: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        ids = v.encode_with_added(texts(part))
        return {"doc_id": part.column("doc_id").cast(pa.int64()), "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids], "offsets": [v.offsets(x).astype("<u4").tobytes() for x in ids]}

    return narrow(docs, id_col, text_col).mapInArrow(per_chunk(run, schema), "doc_id long, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (binary) of what encode() returns; null ids give null."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(part: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        pairs = zip(part.column("ids").to_pylist(), part.column("offsets").to_pylist())
        return {"doc_id": part.column("doc_id"), "decoded": [None if i is None else v.decode(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4").astype(np.int64)) for i, o in pairs]}

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(per_chunk(run, schema, "ids"), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes. Nulls as in encode()."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(part: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        ids = v.encode_with_added(texts(part))
        return {
            "doc_id": part.column("doc_id").cast(pa.int64()),
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(v.decode(x, v.offsets(x))).hexdigest() for x in ids],
        }

    return narrow(docs, id_col, text_col).mapInArrow(per_chunk(run, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
