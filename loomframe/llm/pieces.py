"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``load`` reads a model file and compiles three machines:

* the *normaliser*, from the model's own rules: spaces to marks, a mark before the text, runs of spaces to one;
* the *pieces*: a deterministic acceptor whose arcs are characters and whose final states give a piece and its cost;
* the *fallback*: for each character that no piece has, arcs that give its bytes (or the unknown piece) at a cost.

``Transducer.compose`` walks the machines along an input and gives the arcs of their
composition, a lattice of places and pieces with their ``cost``; ``shortest_path`` is its best path in the
tropical semiring (costs are added along a path, the least of all paths counts).

* ``unigram``: an arc costs minus its piece's score.
* ``bpe``: states are (place, last piece) and an arc costs nothing, or infinity where its piece
  may not follow the last one.  A piece may follow another if merging their joined characters
  gives the two back.  A sequence of pieces is what merging gives for the whole
  text exactly if all neighbours are such pairs, so one path is finite and it is the encoding.

A place whose two characters stand side by side in no piece can never lie inside
one: the input is cut there, and equal stretches are composed once per chunk and kept in a bounded
cache.  Decoding gathers the pieces' bytes and undoes the normaliser.

Not supported, and refused when a model is read: character maps (``precompiled_charsmap``) and marks after words.

Defined cases: null texts have null ids; empty texts have none; a mark (U+2581)
in the text decodes to a space, all else comes back exactly unless the model itself merges spaces;
of paths of equal cost the one whose last piece is longest counts; repeated rows and
ids, and rows without an id, are encoded each for itself; a very long text is one chunk, cut into stretches;
extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow
from .textkernel import chunks, mix64, spans, text_buffer

MARK = "▁"
U = np.uint64
#: Entries kept of encoded stretches and of piece pairs, in one worker.
CACHE = 400_000
#: Fixed values of the model file's format: kinds of pieces, and what an unknown character costs beyond the worst piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNKNOWN_COST = 10.0
INFINITE = float("inf")


@dataclass(frozen=True)
class Rules:
    """The model's normaliser: a mark before the text, marks for spaces, one space for a run of them."""

    prefix: bool = True
    escape: bool = True
    merge: bool = False

    def apply(self, text: str) -> str:
        if self.merge:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        out = (" " if self.prefix else "") + text
        return out.replace(" ", MARK) if self.escape else out


class Transducer:
    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], kind: str = "bpe", rules: Rules = Rules(), unknown: int | None = None, user: tuple[int, ...] = ()):
        """``pieces``: text and score by id, with an empty text for ids that no text makes."""
        self.pieces, self.byte_ids, self.kind, self.rules, self.unknown, self.user = pieces, byte_ids, kind, rules, unknown, user
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p and i not in user}
        self._user = {pieces[i][0]: i for i in user}
        self._whole = re.compile("(" + "|".join(re.escape(p) for p in sorted(self._user, key=lambda p: (-len(p), p))) + ")") if user else None
        self._compile()
        self._follows: dict[int, bool] = {}
        self._made: dict[int, bool] = {}
        self._runs: dict[int, list[tuple[float, str, str]]] = {}
        chars = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self._code = {c: i + 1 for i, c in enumerate(chars)}
        k = len(chars) + 1
        self._joined = np.zeros(k * k, bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self._joined[self._code[a] * k + self._code[b]] = True
        self._k = k
        self._low = np.zeros(0x10000, np.int32)
        for c, i in self._code.items():
            if ord(c) < 0x10000:
                self._low[ord(c)] = i
        out = [p.replace(MARK, " ").encode() for p, _ in pieces]
        out += [b""] * (max(byte_ids.values(), default=0) + 1 - len(out))
        for b, i in byte_ids.items():
            out[i] = bytes([b])
        if unknown is not None:
            out[unknown] = " ⁇ ".encode()
        self._bytes = np.frombuffer(b"".join(out), np.uint8)
        self._at = np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def _compile(self) -> None:
        """The pieces' acceptor: arcs by state and character, and of each final state its piece."""
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for p, i in self.ids.items():
            state = 0
            for c in p:
                to = self.arcs[state].get(c)
                if to is None:
                    to = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(-1)
                state = to
            self.final[state] = i
        worst = min((self.pieces[i][1] for i in self.ids.values()), default=0.0)
        self.fallback_cost = UNKNOWN_COST - worst

    def fallback(self, c: str) -> list[int]:
        """What a character becomes that no piece has."""
        if self.byte_ids:
            return [self.byte_ids[b] for b in c.encode()]
        return [] if self.unknown is None else [self.unknown]

    def compose(self, s: str, start: int) -> list[tuple[int, int]]:
        """Arcs of the lattice that leave a place: where they lead and their piece (-2: fallback)."""
        state, arcs, final, out = 0, self.arcs, self.final, []
        for to in range(start, len(s)):
            state = arcs[state].get(s[to])
            if state is None:
                break
            if final[state] >= 0:
                out.append((to + 1, final[state]))
        if not out or out[0][0] > start + 1:
            out.append((start + 1, -2))
        return out

    def cost(self, p: int) -> float:
        return self.fallback_cost if p == -2 else -self.pieces[p][1]

    def _run(self, p: int) -> list[tuple[float, str, str]]:
        """The merges that make a piece: score, then the first and the last part after each."""
        got = self._runs.get(p)
        if got is None:
            parts, got = list(self.pieces[p][0]), []
            while len(parts) > 1:
                joint = [(self.pieces[i][1], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
                if not joint:
                    break
                score, k = max(joint)
                parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
                got.append((score, parts[0], parts[-1]))
            self._runs[p] = got
        return got

    def made(self, p: int) -> bool:
        """Whether merging a piece's own characters gives it."""
        got = self._made.get(p)
        if got is None:
            run = self._run(p)
            got = self._made[p] = len(self.pieces[p][0]) == 1 or bool(run and run[-1][1] == self.pieces[p][0])
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces gives the two: no merge across is ever the next one."""
        key = a << 20 | b
        got = self._follows.get(key)
        if got is not None:
            return got
        if len(self._follows) > 2 * CACHE:
            self._follows.clear()
        one, two, ids, pieces = self._run(a), self._run(b), self.ids, self.pieces
        x, y, i, j, got = pieces[a][0][-1], pieces[b][0][0], 0, 0, True
        while True:
            left = one[i][0] if i < len(one) else None
            right = two[j][0] if j < len(two) else None
            p = ids.get(x + y)
            if p is not None and (left is None or pieces[p][1] > left) and (right is None or pieces[p][1] >= right):
                got = False
                break
            if left is None and right is None:
                break
            if right is None or (left is not None and left >= right):
                x, i = one[i][2], i + 1
            else:
                y, j = two[j][1], j + 1
        self._follows[key] = got = got and self.made(a) and self.made(b)
        return got

    def _lightest(self, s: str) -> tuple[list[int], list[int]]:
        """Of each place the piece that leads there on the best path, and where it comes from."""
        n = len(s)
        best, last, back = [0.0] + [INFINITE] * n, [-1] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            if best[i] < INFINITE:
                for to, p in self.compose(s, i):
                    c = best[i] + self.cost(p)
                    if c < best[to]:
                        best[to], last[to], back[to] = c, p, i
        return last, back

    def _finite(self, s: str) -> tuple[list[int], list[int]]:
        """As ``_lightest`` where an arc costs nothing or is infinite: of the arcs into a place at most one is finite."""
        n, known = len(s), self._follows
        last, back = [-1] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            a = last[i]
            if i and back[i] < 0:
                continue
            for to, p in self.compose(s, i):
                if back[to] >= 0:
                    continue
                if p == -2:
                    ok = True
                elif a < 0:
                    ok = self.made(p)
                else:
                    ok = known.get(a << 20 | p)
                    if ok is None:
                        ok = self.follows(a, p)
                if ok:
                    last[to], back[to] = p, i
        return last, back

    def shortest_path(self, s: str) -> list[int]:
        """Ids of a normalised stretch."""
        n = len(s)
        last, back = (self._finite if self.kind == "bpe" else self._lightest)(s)
        out: list[int] = []
        i = n
        while i:
            if last[i] == -2:
                out.extend(reversed(self.fallback(s[back[i] : i])))
            else:
                out.append(last[i])
            i = back[i]
        return out[::-1]

    def codes(self, c: np.ndarray) -> np.ndarray:
        out = self._low[np.minimum(c, 0xFFFF)]
        for i in np.flatnonzero(c > 0xFFFF).tolist():
            out[i] = self._code.get(chr(c[i]), 0)
        return out

    def encode(self, texts: list[str], cache: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        norm = [self.rules.apply(t) for t in texts]
        if self._whole:
            return self._encode_around(norm, cache)
        return self._encode(norm, cache)

    def _encode_around(self, norm: list[str], cache: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that the model's user defined are cut out first, the longest at each place."""
        parts = [self._whole.split(t) for t in norm]
        ids, begin = self._encode([x for p in parts for x in p[::2]], cache)
        out, at, k = [], [0], 0
        for p in parts:
            for j in range(len(p)):
                if j % 2:
                    out.append(np.array([self._user[p[j]]], np.uint32))
                else:
                    out.append(ids[begin[k] : begin[k + 1]])
                    k += 1
            at.append(at[-1] + sum(map(len, out[len(out) - len(p) :])))
        return np.concatenate(out) if out else ids, np.array(at, np.int64)

    def _encode(self, norm: list[str], cache: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, norm), np.int64, len(norm))
        whole = "".join(norm)
        c = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(c):
            return np.empty(0, np.uint32), np.zeros(len(norm) + 1, np.int64)
        code = self.codes(c)
        cut = np.ones(len(c), bool)
        cut[1:] = ~self._joined[code[:-1] * self._k + code[1:]]
        begin = np.concatenate(([0], np.cumsum(size)))
        cut[begin[:-1][size > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(c))
        h = _stretch_hash(c, start, end)
        seen, first, inv = np.unique(h, return_index=True, return_inverse=True)
        got = []
        for key, a, b in zip(seen.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            x = cache.get(key)
            if x is None:
                if len(cache) > CACHE:
                    cache.clear()
                x = cache[key] = np.array(self.shortest_path(whole[a:b]), np.uint32).tobytes()
            got.append(x)
        n_each = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        flat, at = np.frombuffer(b"".join(got), np.uint32), np.concatenate(([0], np.cumsum(n_each)))
        ids = flat[np.repeat(at[:-1][inv], n_each[inv]) + spans(n_each[inv])]
        before = np.concatenate(([0], np.cumsum(n_each[inv])))
        at = before[np.searchsorted(start, begin)]
        if self.unknown is not None and not self.byte_ids and len(ids):  # a run of unknown characters is one piece
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            keep[at[:-1][at[:-1] < len(ids)]] = True
            ids, at = ids[keep], np.concatenate(([0], np.cumsum(keep)))[at]
        return ids, at

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """UTF-8 of each text."""
        n = self._at[ids + 1] - self._at[ids]
        raw = self._bytes[np.repeat(self._at[ids], n) + spans(n)].tobytes()
        at = np.concatenate(([0], np.cumsum(n)))[begin].tolist()
        lead = int(self.rules.prefix)
        return [raw[a + lead : b] if b > a else b"" for a, b in zip(at, at[1:], strict=False)]


def _stretch_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch of characters: a sum of terms by character and place."""
    i = np.arange(len(c)) - np.repeat(start, end - start)
    term = mix64(c.astype(np.uint64) << U(32) | i.astype(np.uint64))
    return np.add.reduceat(term, start)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the model file's wire format."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 0x7F) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 0x80:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[tag & 7]
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


def compile_model(data: bytes) -> Transducer:
    pieces, kinds, model, norm = [], [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            model = dict(fields(value))
        elif number == 3:
            norm = dict(fields(value))
    if norm.get(2):
        raise ValueError("the model's normaliser has a character map, which is not supported")
    if model.get(24):
        raise ValueError("marks after words are not supported")
    if model.get(3, 1) not in (1, 2):
        raise ValueError("only unigram and bpe models are supported")
    byte_ids = {int(p[3:-1], 16): i for i, (p, _) in enumerate(pieces) if kinds[i] == BYTE}
    unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), None)
    made = [(p if kinds[i] in (NORMAL, USER) else "", score) for i, (p, score) in enumerate(pieces)]
    rules = Rules(bool(norm.get(3, 1)), bool(norm.get(5, 1)), bool(norm.get(4, 1)))
    return Transducer(made, byte_ids, "unigram" if model.get(3, 1) == 1 else "bpe", rules, unknown, tuple(i for i, k in enumerate(kinds) if k == USER))


def load(path: str) -> Transducer:
    """From a SentencePiece model file, whose path is the caller's; the driver reads it."""
    with open(path, "rb") as f:
        return compile_model(f.read())


_WORKER: dict = {}


def _held(spark, t: Transducer):
    """What workers compile a transducer from, and a digest that tells it from others."""
    args = (t.pieces, t.byte_ids, t.kind, t.rules, t.unknown, t.user)
    return spark.sparkContext.broadcast(args), hashlib.sha256(repr(args).encode()).hexdigest()


def _worker(held) -> tuple[Transducer, dict[int, bytes]]:
    """This worker's transducer and cache, compiled once for each model."""
    args, key = held
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = (Transducer(*args.value), {})
    return _WORKER[key]


def _parts(rb: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, int]]:
    return chunks(text_buffer(rb.column(text_col))[1])


def encode(docs: DataFrame, transducer: Transducer, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ids (array<int>), and decoded: the text that these ids give back."""
    held = _held(docs.sparkSession, transducer)
    kinds = dict(docs.dtypes)

    def run(batches):
        t, cache = _worker(held)
        for rb in batches:
            for a, b in _parts(rb, text_col):
                part = rb.slice(a, b - a)
                texts = part.column(text_col).to_pylist()
                null = np.array([x is None for x in texts], bool)
                ids, begin = t.encode([x or "" for x in texts], cache)
                back = t.decode(ids, begin)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(null))
                text = pa.array([None if z else x for x, z in zip(back, null.tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, text], [*keep, "ids", "decoded"])

    cols = list(dict.fromkeys([*keep, text_col]))
    return map_arrow(docs.select(*cols), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids array<int>, decoded string")


def decode(rows: DataFrame, transducer: Transducer, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the text of each list of ids."""
    held = _held(rows.sparkSession, transducer)
    kinds = dict(rows.dtypes)

    def run(batches):
        t, _ = _worker(held)
        for rb in batches:
            lists = rb.column(ids_col)
            ids = [np.array(x or [], np.int64) for x in lists.to_pylist()]
            begin = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            out = t.decode(np.concatenate(ids) if ids else np.empty(0, np.int64), begin)
            text = pa.array([x if v else None for x, v in zip(out, lists.is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), text], [*keep, "text"])

    return map_arrow(rows.select(*keep, ids_col), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string")


def summary(encoded: DataFrame) -> list:
    """Digest columns of ``encode``'s rows."""
    return [
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<int>")), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"),
    ]
