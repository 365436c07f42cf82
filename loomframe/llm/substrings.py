"""Substring dedup by seed and extend on winnowed anchors.

Seeds.  Of any ``WINDOW`` = 13 consecutive words the smallest hash among its seven
7-word grams is its anchor (winnowing), so equal windows share their anchor, at the same offset.  A
first shuffle joins documents on anchors and marks those that stand in two documents or more.

Extension.  A match can only lie around a marked anchor.  Of each, the words up to
which its windows reach, six to the left and six to the right at most, go with it to a second shuffle.
There every occurrence of an anchor is extended both ways: a window of a document matches
if the words to the left and to the right of the seed equal, word by word, those of a document of
smaller id.  The occurrences are sorted by what stands around the seed, and each is compared with the
first of its run, so pairs of documents are never formed, and a passage that a third of all documents share costs what any other does.

Repeats.  Matched windows of one document that follow one another are one match, extended as far as it
goes: their runs are the maximal repeats (``spans``), 13 words or longer, and are removed.

Words are compared by 64-bit hashes, thirteen a window; a false match needs two different words of one hash in
otherwise equal windows.

Both shuffles combine first: of an anchor or window that several documents of one
batch hold, one record leaves the task, and what the batch itself settles is
only passed on.  Texts are shuffled only for documents that a Bloom
filter of bounded size does not rule out.

Defined cases: a null text has no words; fewer than 13 words hold no window; a
passage repeated within one document only is kept; of documents that tie, having equal texts, the smallest id
keeps its words; rows of one id never remove
from each other; rows with a null id are kept whole and remove nothing; a very long text is one chunk in one task; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, bloom
from .tables import bucket_count, map_arrow, write_shared
from .textkernel import chunks, gram_hashes, mix64, spans as counting, text_buffer, word_hashes, words

WINDOW, SEED = 13, 7
BATCH_BYTES, SEED_BYTES = 4 << 20, 2 << 20
#: Buckets of seeds with their words for each bucket of anchors.
SPREAD = 3
MARKS = "id long, fp long, pos binary"


class Windows:
    """All windows of some documents: document, start word, own anchor's word, anchor hash, window hash; and the words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf = buf
        self.starts, self.ends, self.at = words(buf, off)
        self.h = word_hashes(buf, self.starts, self.ends)
        count = np.maximum(np.diff(self.at) - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.pos = counting(count)
        if not len(self.pos):
            self.place, self.anchor, self.whole = self.pos, np.empty(0, np.uint64), np.empty(0, np.uint64)
            return
        w = self.at[self.doc] + self.pos
        g = gram_hashes(self.h, SEED)
        m = len(g) - (WINDOW - SEED)
        low, place = g[:m].copy(), np.zeros(m, np.int64)
        for k in range(1, WINDOW - SEED + 1):
            less = g[k : k + m] < low
            low[less] = g[k : k + m][less]
            place[less] = k
        self.place, self.anchor, self.whole = self.pos + place[w], low[w], gram_hashes(self.h, WINDOW)[w]


class _Batch:
    """Anchors (hash, document, place) of some MB of text."""

    def __init__(self):
        self.h, self.id, self.fp, self.pos, self.bytes = [], [], [], [], 0

    def add(self, h, ids, fps, pos, size):
        for x, y in ((self.h, h), (self.id, ids), (self.fp, fps), (self.pos, pos.astype(np.uint32))):
            x.append(y)
        self.bytes += size

    def rows(self, buckets: int, turn: int) -> pa.RecordBatch:
        """Of each anchor that one document of the batch holds all its places, of the others the first and that they are shared."""
        h, ids, fps, pos = map(np.concatenate, (self.h, self.id, self.fp, self.pos))
        order = np.lexsort((ids, h))
        h, ids, fps, pos = h[order], ids[order], fps[order], pos[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = np.cumsum(first) - 1
        many = np.zeros(int(group[-1]) + 1, bool) if len(h) else np.zeros(0, bool)
        many[group[ids != ids[np.flatnonzero(first)][group]]] = True
        settled = many[group]
        send = np.flatnonzero(~settled | first)
        flag = settled[send].astype(np.uint8)
        out_k, out_b = [], []
        by, edge = blobs.by_bucket(mix64(h[send]), buckets)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            part = send[by[edge[k] : edge[k + 1]]]
            out_k.append(k)
            out_b.append(blobs.pack([h[part], *_told(ids[part], fps[part]), pos[part], flag[by[edge[k] : edge[k + 1]]]]))
        local = np.flatnonzero(settled)
        if len(local):
            out_k.append(turn % buckets)
            out_b.append(_local(ids[local], fps[local], pos[local]))
        return blobs.batch(out_k, out_b)


def _local(ids: np.ndarray, fps: np.ndarray, pos: np.ndarray) -> bytes:
    """Marks that are settled already, in the frame of what is yet to be."""
    return blobs.pack([np.empty(0, np.uint64), *_told(ids, fps), pos.astype(np.uint32), np.empty(0, np.uint8)])


def _told(ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's place in a table of documents, and that table."""
    key = np.empty(len(ids), [("id", np.int64), ("fp", np.int64)])
    key["id"], key["fp"] = ids, fps
    order = np.lexsort((fps, ids))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    place = np.empty(len(k), np.uint32)
    place[order] = np.cumsum(new) - 1
    return place, k["id"][new].view(np.uint64), k["fp"][new].view(np.uint64)


def _mark_blobs(ids, fps, pos, buckets: int) -> pa.RecordBatch:
    """Marks packed by the bucket of their document."""
    order, edge = blobs.by_bucket(mix64(ids.view(np.uint64)), buckets)
    some = np.flatnonzero(np.diff(edge)).tolist()
    out = []
    for k in some:
        part = order[edge[k] : edge[k + 1]]
        out.append(blobs.pack([*_told(ids[part], fps[part]), pos[part]]))
    return blobs.batch(some, out)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with all its marked places."""
    frames = list(blobs.frames(batches))
    if frames:
        ids = np.concatenate([f[1].view(np.int64)[f[0]] for f in frames])
        fps = np.concatenate([f[2].view(np.int64)[f[0]] for f in frames])
        pos = np.concatenate([f[3] for f in frames])
        order = np.lexsort((pos, fps, ids))
        ids, fps, pos = ids[order], fps[order], pos[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1])
        at = np.flatnonzero(new)
        for i in range(0, len(at), 4096):
            part = at[i : i + 4096]
            end = int(at[i + 4096]) if i + 4096 < len(at) else len(ids)
            edge = np.append(part, end) - part[0]
            data = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((edge * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pos[part[0] : end], np.uint32))])
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(fps[part]), data], ["id", "fp", "pos"])


def _shared(buckets: int):
    """Marks of each bucket's anchors that two documents hold."""

    def run(batches):
        frames = []
        for f in blobs.frames(batches):
            if len(f[0]):
                frames.append(f)
            else:
                yield _mark_blobs(f[2].view(np.int64)[f[1]], f[3].view(np.int64)[f[1]], f[4], buckets)
        if not frames:
            return
        h = np.concatenate([f[0] for f in frames])
        ids = np.concatenate([f[2].view(np.int64)[f[1]] for f in frames])
        fps = np.concatenate([f[3].view(np.int64)[f[1]] for f in frames])
        pos = np.concatenate([f[4] for f in frames])
        flag = np.concatenate([f[5] for f in frames]).astype(bool)
        del frames
        order = np.lexsort((ids, h))
        h, ids, flag = h[order], ids[order], flag[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = np.cumsum(first) - 1
        many = np.zeros(int(group[-1]) + 1, bool)
        many[group[(ids != ids[np.flatnonzero(first)][group]) | flag]] = True
        hit = many[group] & ~flag
        yield _mark_blobs(ids[hit], fps[order[hit]], pos[order[hit]], buckets)

    return run


def _anchors(buckets: int):
    def run(batches):
        held, turn = _Batch(), 0
        for rb in batches:
            buf, off = text_buffer(rb.column("text"))
            ids, fps = rb.column("id").to_numpy(zero_copy_only=False), rb.column("fp").to_numpy(zero_copy_only=False)
            for a, b in chunks(off):
                w = Windows(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                if len(w.doc):
                    new = np.ones(len(w.doc), bool)
                    new[1:] = (w.doc[1:] != w.doc[:-1]) | (w.place[1:] != w.place[:-1])
                    doc = w.doc[new] + a
                    held.add(w.anchor[new], ids[doc], fps[doc], w.place[new], int(off[b] - off[a]))
                if held.bytes > BATCH_BYTES:
                    yield held.rows(buckets, turn)
                    held, turn = _Batch(), turn + 1
        if held.bytes:
            yield held.rows(buckets, turn)

    return run


def equal_words(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows that start at these words agree in each word."""
    same = np.ones(len(a), bool)
    for k in range(WINDOW):
        same &= h[a + k] == h[b + k]
    return same


def later(h: np.ndarray, whole: np.ndarray, first_word: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Windows that equal, word by word, a window of a smaller id among these."""
    hit = np.zeros(len(ids), bool)
    left = np.arange(len(ids))
    while len(left):  # again only for windows of one hash that differ in their words
        order = left[np.lexsort((ids[left], whole[left]))]
        new = np.ones(len(order), bool)
        new[1:] = whole[order][1:] != whole[order][:-1]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = equal_words(h, first_word[order], first_word[head])
        hit[order[same & (ids[order] != ids[head])]] = True
        left = order[~same]
    return hit


def _seeds(buckets: int):
    """Of each marked anchor the words around it that its windows reach, and which windows those are (a bit each, by the anchor's offset)."""

    def rows(w: Windows, ids: np.ndarray, fps: np.ndarray, marked: np.ndarray, base: np.ndarray, turn: int) -> pa.RecordBatch | None:
        hit = np.flatnonzero(marked[base[w.doc] + w.place])
        if not len(hit):
            return None
        doc, pos, place = w.doc[hit], w.pos[hit], w.place[hit]
        gone = later(w.h, w.whole[hit], w.at[doc] + pos, ids[doc])
        out_k, out_b = [], []
        if gone.any():
            out_k.append(turn % buckets)
            out_b.append(_local(ids[doc[gone]], fps[doc[gone]], pos[gone]))
        hit, doc, pos, place = hit[~gone], doc[~gone], pos[~gone], place[~gone]
        new = np.ones(len(hit), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(new)
        if len(at):
            mask = np.bitwise_or.reduceat(1 << (place - pos), at).astype(np.uint8)
            doc, place = doc[at], place[at]
            first, last = w.at[doc] + pos[at], w.at[doc] + pos[np.append(at[1:], len(pos)) - 1] + WINDOW - 1
            size = w.ends - w.starts  # the words side by side, one space after each
            plain = np.full(int(size.sum()) + len(size), 32, np.uint8)
            begin = np.concatenate(([0], np.cumsum(size + 1)))
            plain[np.repeat(begin[:-1], size) + counting(size)] = w.buf[np.repeat(w.starts, size) + counting(size)]
            n = begin[last + 1] - begin[first]
            by, edge = blobs.by_bucket(mix64(w.anchor[hit][at]), buckets)
            for k in np.flatnonzero(np.diff(edge)).tolist():
                part = by[edge[k] : edge[k + 1]]
                text = plain[np.repeat(begin[first[part]], n[part]) + counting(n[part])]
                out_k.append(k)
                out_b.append(blobs.pack([n[part].astype(np.uint32), *_told(ids[doc[part]], fps[doc[part]]), place[part].astype(np.uint32), mask[part], text]))
        return blobs.batch(out_k, out_b)

    def run(batches):
        turn = 0
        for rb in batches:
            buf, off = text_buffer(rb.column("text"))
            ids, fps = rb.column("id").to_numpy(zero_copy_only=False), rb.column("fp").to_numpy(zero_copy_only=False)
            marks = rb.column("pos")
            for a, b in chunks(off, SEED_BYTES):
                w = Windows(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                base = np.concatenate(([0], np.cumsum(np.diff(off[a : b + 1]) + 1)))
                marked = np.zeros(int(base[-1]) + 1, bool)
                for i in range(a, b):
                    marked[base[i - a] + np.frombuffer(marks[i].as_buffer(), np.uint32)] = True
                out = rows(w, ids[a:b], fps[a:b], marked, base, turn)
                turn += 1
                if out is not None:
                    yield out

    return run


def _extend(buckets: int):
    """Marks of the windows that an earlier document holds, by extending each bucket's seeds both ways."""

    def run(batches):
        frames = []
        for f in blobs.frames(batches):
            if len(f[0]):
                frames.append(f)
            else:
                yield _mark_blobs(f[2].view(np.int64)[f[1]], f[3].view(np.int64)[f[1]], f[4], buckets)
        if not frames:
            return
        off = np.concatenate(([0], np.cumsum(np.concatenate([f[0] for f in frames]).astype(np.int64))))
        ids = np.concatenate([f[2].view(np.int64)[f[1]] for f in frames])
        fps = np.concatenate([f[3].view(np.int64)[f[1]] for f in frames])
        place = np.concatenate([f[4] for f in frames]).astype(np.int64)
        mask = np.concatenate([f[5] for f in frames])
        buf = np.concatenate([f[6] for f in frames])
        del frames
        at = [np.zeros(1, np.int64)]
        hashes = []
        for a, b in chunks(off):
            starts, ends, own = words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            hashes.append(word_hashes(buf[off[a] : off[b]], starts, ends))
            at.append(at[-1][-1] + own[1:])
        del buf
        h, at = np.concatenate(hashes), np.concatenate(at)
        reach = np.frexp(mask.astype(np.float64))[1] - 1  # how many words stand left of the seed
        seed, first = [], []
        for o in range(WINDOW - SEED + 1):
            some = np.flatnonzero(mask >> o & 1)
            seed.append(some)
            first.append(at[some] + reach[some] - o)
        shift = np.repeat(np.arange(len(seed)), [len(x) for x in seed])
        seed, first = np.concatenate(seed), np.concatenate(first)
        hit = later(h, gram_hashes(h, WINDOW)[first], first, ids[seed])
        seed = seed[hit]
        yield _mark_blobs(ids[seed], fps[seed], (place[seed] - shift[hit]).astype(np.uint32), buckets)

    return run


def _passed(held, keep: bool):
    """Rows that the Bloom filter may hold, or those that it rules out."""

    def run(batches):
        for rb in batches:
            at = rb.column("at").flatten().to_numpy().reshape(-1, len(bloom.SEEDS))
            got = bloom.may_hold(held.value, at) & ~rb.column("id").is_null().to_numpy(zero_copy_only=False)
            yield rb.filter(pa.array(got == keep)).select(["id", "fp", "text"])

    return run


def repeat_marks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): rows are id, fp, text, at; marks are id, fp, places where a repeated window starts."""
    spark = docs.sparkSession
    buckets = bucket_count(spark, docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"), bloom.places(F.col(id_col).cast("long")).alias("at"))
    told = rows.filter("id is not null").select("id", "fp", "text")

    def marks_of(items: DataFrame, of: int, settle) -> DataFrame:
        settled = map_arrow(blobs.deal(items, of), settle, blobs.SCHEMA)
        return write_shared(map_arrow(blobs.deal(settled, buckets), _merge, MARKS), "marks")

    shared = marks_of(map_arrow(told, _anchors(buckets), blobs.SCHEMA), buckets, _shared(buckets))
    held = spark.sparkContext.broadcast(bloom.build(shared.select("id"), "id"))
    some = map_arrow(rows, _passed(held, True), "id long, fp long, text string")
    wide = buckets * SPREAD
    found = map_arrow(some.join(shared, ["id", "fp"]), _seeds(wide), blobs.SCHEMA)
    return rows, marks_of(found, wide, _extend(buckets))


def _covered(n_words: int, at: np.ndarray) -> np.ndarray:
    """True for each word that a marked window covers."""
    step = np.bincount(at, minlength=n_words + 1) - np.bincount(np.minimum(at.astype(np.int64) + WINDOW, n_words), minlength=n_words + 1)
    return np.cumsum(step[:-1]) > 0


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        n_words, n_removed, text, runs = [], [], [], []
        marks = rb.column("pos") if "pos" in rb.schema.names else None
        for i, t in enumerate(rb.column("text")):
            w = bytes(t.as_buffer()).split() if t.is_valid else []  # splits at 0x20 and 0x09-0x0D
            removed, own = 0, []
            if marks is not None and marks[i].is_valid:
                gone = _covered(len(w), np.frombuffer(marks[i].as_buffer(), np.uint32))
                removed = int(gone.sum())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                own = [{"start": s, "n": e - s} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                kept = b" ".join(compress(w, (~gone).tolist()))
            else:
                kept = b" ".join(w)
            n_words.append(len(w))
            n_removed.append(removed)
            text.append(hashlib.sha256(kept).hexdigest())
            runs.append(own)
        yield pa.RecordBatch.from_arrays(
            [rb.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(text), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))],
            ["id", "n_words", "n_removed", "kept_sha256", "spans"],
        )


KEPT = "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, n: long>>"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and the maximal repeats that were removed (``spans``, in words)."""
    spark = docs.sparkSession
    rows, marks = repeat_marks(docs, id_col, text_col)
    held = spark.sparkContext.broadcast(bloom.build(marks.select("id"), "id"))
    text = "id long, fp long, text string"
    whole = map_arrow(map_arrow(rows, _passed(held, False), text), _keep, KEPT)
    some = map_arrow(rows, _passed(held, True), text).join(marks, ["id", "fp"], "left")
    out = whole.unionByName(map_arrow(some.select("id", "fp", "text", "pos"), _keep, KEPT))
    return out.withColumnRenamed("id", id_col)
