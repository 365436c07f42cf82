"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its 5-word shingles; two link when their Jaccard
similarity is at least ``threshold`` (0.75).  All tokens have one global order:
frequent ones, as counted over all documents, stand last.  Documents
with equal sets are one node throughout, so exact copies are never paired.

Prefixes.  A node x with n tokens needs at least a = ceil(t n) of them in any
partner.  If x keeps its first n - a + l tokens and y likewise with its own l,
a linked pair shares at least min(l_x, l_y) kept tokens.  Each node chooses its
l by estimated cost: a longer prefix adds postings, but demands more matches, so
fewer candidates are verified.  The counts only steer this choice and
the order; no link depends on them.

Links are then found over the postings that occur in two nodes or more:

1. every node is verified against one *head* that it shares postings with (of each
   list the most central node in reach by length), the one with most matches: one
   candidate per node, however large a group of near copies is; components of these links are formed;
2. nodes that share long posting lists form clusters; within a cluster the
   overlaps of nodes of different components are counted block by block, and only
   links that join components leave a task;
3. of short lists, every pair of nodes of different components and clusters that
   shares at least min(l_x, l_y) postings is verified.

A pair that is skipped is already connected, so the components are those of all
links, and no group of near copies is ever written out as pairs.

Link counts are a step of their own (``links=True``): linked documents are of one component, so the different sets of
each component are compared block by block, and one number for each set and pair of blocks leaves a task.  This
grows with the square of a component's different sets; the components alone do not need it.

Scale: postings are dealt by token in compressed arrays, in buckets that follow the bytes of the input; lists that the
counts show as very long are dealt by their nodes as well, each part with a head of its own and the heads in a list again; clusters are cut into
blocks of bounded size; verification ships texts to salted head keys and streams past one set at a time.  Where the
texts of a step are more than ``SHIPPED`` of the input, they are shipped in rounds; the shuffle files of a finished step or round are deleted
before the next begins, so the disk follows the largest step and not their sum.
Tokens are counted by 32 bits of their hash, sorted and dealt as gaps of 10 to 14 bits.  Broadcast are
a table of 4 MB (the highest rank of the tokens of each slot), the tokens of more than ``LIST`` documents and a Bloom filter of 128 MB at most.

Hashes: a shingle is 48 bits, a node 64 bits of its whole set.  A pair is compared by its shingles' hashes, so one pair in
about 10**8 of 1,000 shingles each counts one too many in common; equal nodes are not compared again, so among 10**11 different sets about 270 are taken for another.

Defined cases: null or wordless texts have an empty set and link with nothing;
fewer than 5 words make one shingle; a similarity of exactly the threshold links; of heads that tie, the one of larger node hash is taken, which changes no component; rows that repeat an id are documents of
their own that share its value; rows with a null id are returned, but link with nothing
unless another row has their set; a very long text is one chunk in one task; extra columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, bloom
from .components import components
from .tables import bucket_count, cut, estimated_bytes, few_parts, free, map_arrow, write_shared
from .textkernel import FOLD_CASE, chunks, gram_hashes, mix64, sequence_hash, spans, text_buffer, word_hashes, words

U = np.uint64
#: Bits of a token: rank of its frequency, then hash.  The rest holds a document's place in its chunk.
RANK_BITS, HASH_BITS = 4, 48
DOCS = 1 << (64 - RANK_BITS - HASH_BITS)
#: One in SAMPLE documents is counted: all of them, whatever stands here.  Tokens of more than RARE documents have a rank above 0.
SAMPLE, RARE = 1, 16
#: Bits by which a token is counted and by which its rank is looked up; tokens that are packed at once.
COUNT_BITS, SLOT_BITS, PACKED = 32, 22, 4_000_000
#: Tokens of a block of a cluster, and members of a head, that one task compares.
BLOCK_TOKENS, MEMBERS = 600_000, 512
BATCH_BYTES = 8 << 20
#: Posting lists up to this length are short: their pairs are listed.
SMALL = 64
#: Nodes of a posting list that one task looks at; tokens from this rank on are dealt by their nodes as well.
LIST, HOT = 50_000, 15
#: Bytes of text on disk for each token, and texts that are shipped at once, as a share of the input's bytes.  They are dealt twice, so twice that is on disk.
TOKEN_BYTES, SHIPPED = 3.5, 0.5


class Frequent:
    """Ranks of shingle hashes by their document counts, and the counts of those whose lists are dealt by nodes.

    A slot holds the highest rank of its tokens, so that no token is taken for rarer than it is, however many are frequent.
    """

    def __init__(self, slot: np.ndarray, rank: np.ndarray, h: np.ndarray, count: np.ndarray, hot: int, most: int):
        order = np.argsort(h)
        self.h, self.count, self.hot, self.most = h[order], count[order], hot, most
        self.rank = np.zeros(1 << SLOT_BITS, np.uint8)
        self.rank[slot] = rank

    def ranks(self, h: np.ndarray) -> np.ndarray:
        return self.rank[(h >> U(HASH_BITS - SLOT_BITS)).astype(np.int64)].astype(np.uint64)

    def parts(self, tokens: np.ndarray) -> np.ndarray:
        """Into how many parts the list of each token is dealt, by its document count."""
        out = np.ones(len(tokens), np.int64)
        at = np.flatnonzero(tokens >> U(HASH_BITS) >= self.hot)
        if len(at) and len(self.h):
            h = (tokens[at] & U((1 << HASH_BITS) - 1)) >> U(HASH_BITS - COUNT_BITS)
            i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = self.h[i] == h
            out[at[hit]] = np.maximum(-(-self.count[i[hit]] // self.most), 1)
        return out


def shingle_sets(col: pa.Array, n: int, frequent: Frequent | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, offsets): sorted distinct tokens of each row, chunk by chunk."""
    buf, off = text_buffer(col)
    for a, b in chunks(off):
        for lo in range(a, b, DOCS):
            hi = min(b, lo + DOCS)
            part, own = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            starts, ends, at = words(part, own)
            wh = word_hashes(part, starts, ends, FOLD_CASE)
            count = np.diff(at)
            grams = gram_hashes(wh, n)
            doc = np.repeat(np.arange(hi - lo), np.maximum(count - n + 1, 0))
            h = grams[at[doc] + spans(np.maximum(count - n + 1, 0))] if len(grams) else grams
            short = np.flatnonzero((count > 0) & (count < n))
            if len(short):
                h = np.concatenate((h, np.array([sequence_hash(wh[at[i] : at[i + 1]]) for i in short], np.uint64)))
                doc = np.concatenate((doc, short))
            h = h >> U(64 - HASH_BITS)
            rank = frequent.ranks(h) if frequent else U(0)
            key = np.sort(doc.astype(np.uint64) << U(RANK_BITS + HASH_BITS) | rank << U(HASH_BITS) | h)
            if len(key):
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            edges = np.searchsorted(key, np.arange(hi - lo + 1).astype(np.uint64) << U(RANK_BITS + HASH_BITS)) if hi - lo < DOCS else np.append(np.searchsorted(key, np.arange(hi - lo).astype(np.uint64) << U(RANK_BITS + HASH_BITS)), len(key))
            yield lo, hi, key & U((1 << (RANK_BITS + HASH_BITS)) - 1), edges


def _signatures(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on ranks; 0 for an empty one."""
    m = mix64(tokens & U((1 << HASH_BITS) - 1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(m)))
    n = np.diff(edges)
    out = mix64(total[edges[1:]] - total[edges[:-1]] + n.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    out[n == 0] = 0
    return out


def _needed(n: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """ceil(t n)"""
    return -(-n * t[0] // t[1])


def nodes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, size, node of every document; node is null where the set is empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for rb in batches:
            for a, b, tokens, edges in shingle_sets(rb.column(text_col), n):
                size, sig = np.diff(edges), _signatures(tokens, edges)
                yield pa.RecordBatch.from_arrays([rb.column(id_col).slice(a, b - a), pa.array(size), pa.array(sig.view(np.int64), mask=size == 0)], [id_col, "size", "node"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, size long, node long")


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of these numbers, all lowest ones first: those that are zero throughout take no room once compressed."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).ravel().view("<u4")


def _counted(text_col: str, n: int, buckets: int):
    """Frames of each bucket: gaps of the sorted hashes of a task, and the number of its documents that hold each."""

    def flush(held):
        h, c = np.unique(np.concatenate(held), return_counts=True)
        edge = np.searchsorted(h, np.arange(1, buckets, dtype=np.uint64) * U(1 << COUNT_BITS) // U(buckets))
        edge = [0, *edge.tolist(), len(h)]
        out_k, out_b = [], []
        for k in range(buckets):
            part = h[edge[k] : edge[k + 1]]
            if len(part):
                out_k.append(k)
                out_b.append(blobs.pack([_planes(np.concatenate((part[:1], np.diff(part)))), _planes(c[edge[k] : edge[k + 1]])]))
        return blobs.batch(out_k, out_b)

    def run(batches):
        held, many = [], 0
        for rb in batches:
            for _, _, tokens, _ in shingle_sets(rb.column(text_col), n):
                held.append((tokens >> U(HASH_BITS - COUNT_BITS)).astype(np.uint32))
                many += len(tokens)
                if many > PACKED:
                    yield flush(held)
                    held, many = [], 0
        if many:
            yield flush(held)

    return run


def _summed(least: int):
    """(h, c): the hashes of a bucket that stand in more than ``least`` documents, and in how many."""

    def run(batches):
        hs, cs = [], []
        for h, c in blobs.frames(batches):
            hs.append(np.cumsum(_numbers(h), dtype=np.uint32))
            cs.append(_numbers(c))
        if not hs:
            return
        h, c = np.concatenate(hs), np.concatenate(cs)
        order = np.argsort(h)
        h, c = h[order], c[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.add.reduceat(c.astype(np.int64), at)
        hit = total > least
        yield pa.RecordBatch.from_arrays([pa.array(h[at[hit]].astype(np.int64)), pa.array(total[hit])], ["h", "c"])

    return run


def token_counts(docs: DataFrame, text_col: str, n: int, least: int, buckets: int) -> DataFrame:
    """(h, c): the first COUNT_BITS bits of each token that stands in more than ``least`` of all documents, and in how many."""
    found = map_arrow(docs.select(text_col), _counted(text_col, n, buckets), blobs.SCHEMA)
    return map_arrow(blobs.deal(found, buckets), _summed(least), "h long, c long")


def frequent_tokens(docs: DataFrame, id_col: str, text_col: str, n: int) -> Frequent:
    """Ranks by the number of documents, counted over all of them."""
    seen = write_shared(token_counts(docs, text_col, n, min(RARE, LIST // 2), bucket_count(docs.sparkSession, docs)), "counts")
    rank = F.least(F.floor(F.log2("c")).cast("int") + 1, F.lit((1 << RANK_BITS) - 1))
    slots = seen.groupBy(F.shiftright("h", COUNT_BITS - SLOT_BITS).cast("int").alias("slot")).agg(F.max(rank).cast("byte").alias("rank")).toArrow()
    hot = seen.filter(F.col("c") > LIST).toArrow()
    return Frequent(slots.column("slot").to_numpy(), slots.column("rank").to_numpy(), hot.column("h").to_numpy().view(np.uint64), hot.column("c").to_numpy(), HOT, LIST)


def centrality(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean document count, by rank, of each set's tokens: of near copies, the one that the others were made from has the most."""
    rank = (tokens >> U(HASH_BITS)).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(np.where(rank > 0, (1 << np.maximum(rank - 1, 0)), 0))))
    return np.minimum((total[edges[1:]] - total[edges[:-1]]) * 16 // np.maximum(np.diff(edges), 1), (1 << 31) - 1)


#: Share of the set by which a prefix may be lengthened.
STEPS = (0, 32, 16, 8, 4)


def prefixes(tokens: np.ndarray, edges: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix length and demanded matches of each set, by least estimated cost.

    With d the document counts by rank (1 for tokens of rank 0), a prefix of p tokens costs p postings, and about sum(d - 1) / l
    candidates share l of them; a verification costs as much as ``n`` postings.
    """
    n = np.diff(edges)
    need = _needed(n, t)
    rank = (tokens >> U(HASH_BITS)).astype(np.int64)
    extra = np.concatenate(([0], np.cumsum(np.where(rank > 0, (1 << np.maximum(rank - 1, 0)).astype(np.float64), 0.02))))
    best, length, demand = np.full(len(n), np.inf), np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    for s in STEPS:
        l = np.minimum(np.maximum(n // s if s else 1, 1), np.maximum(need, 1))
        p = np.minimum(n - need + l, n)
        cost = p + (extra[edges[:-1] + p] - extra[edges[:-1]]) / l * n
        take = cost < best
        best[take], length[take], demand[take] = cost[take], p[take], l[take]
    return length, demand


def _postings(text_col: str, n: int, t: tuple[int, int], buckets: int, frequent):
    def flush(tok, sig, size, dem, weight):
        tok, sig, size, dem, weight = map(np.concatenate, (tok, sig, size, dem, weight))
        key, parts = mix64(tok), frequent.value.parts(tok)
        hot = np.flatnonzero(parts > 1)
        key[hot] = mix64(tok[hot] ^ mix64(sig[hot] % parts[hot].astype(np.uint64) + U(1)))
        order, edge = blobs.by_bucket(key, buckets)
        out_k, out_b = [], []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            part = order[edge[k] : edge[k + 1]]
            ids, at, place = np.unique(sig[part], return_index=True, return_inverse=True)
            o = np.argsort(place, kind="stable")
            first = part[at]
            out_k.append(k)
            out_b.append(blobs.pack([tok[part][o], place[o].astype(np.uint32), ids, *(x[first].astype(np.uint32) for x in (size, dem, weight))]))
        return blobs.batch(out_k, out_b)

    def run(batches):
        fr, held, bytes_ = frequent.value, ([], [], [], [], []), 0
        seen: set[int] = set()
        for rb in batches:
            for a, b, tokens, edges in shingle_sets(rb.column(text_col), n, fr):
                sig = _signatures(tokens, edges)
                length, demand = prefixes(tokens, edges, t)
                fresh = np.zeros(len(sig), bool)
                fresh[np.unique(sig, return_index=True)[1]] = True
                fresh &= (sig != 0) & np.fromiter((x not in seen for x in sig.tolist()), bool, len(sig))
                seen.update(sig[fresh].tolist())
                length = np.where(fresh, length, 0)
                doc = np.repeat(np.arange(b - a), length)
                tok = tokens[edges[doc] + spans(length)]
                for x, y in zip(held, (tok, sig[doc], np.diff(edges)[doc], demand[doc], centrality(tokens, edges)[doc]), strict=True):
                    x.append(y)
                bytes_ += len(tok) * 24
                if bytes_ > BATCH_BYTES:
                    yield flush(*held)
                    held, bytes_ = ([], [], [], [], []), 0
                    seen.clear()
        if bytes_:
            yield flush(*held)

    return run


POSTING = "token long, node long, size int, demand int, weight int, df int, low long"


def _shared_postings(frequent):
    """Postings whose token stands in two nodes or more, sorted by token and node.

    ``low`` is one node of the list.  A token that is dealt by its nodes is kept whatever a task sees of it; its ``df`` is that of all parts, and long in any case.
    """

    def run(batches):
        frames = list(blobs.frames(batches))
        if not frames:
            return
        tok = np.concatenate([f[0] for f in frames])
        sig = np.concatenate([f[2][f[1]] for f in frames])
        size = np.concatenate([f[3][f[1]] for f in frames])
        dem = np.concatenate([f[4][f[1]] for f in frames])
        weight = np.concatenate([f[5][f[1]] for f in frames])
        del frames
        order = np.lexsort((sig, tok))
        tok, sig = tok[order], sig[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
        order, tok, sig = order[new], tok[new], sig[new]
        first = np.ones(len(tok), bool)
        first[1:] = tok[1:] != tok[:-1]
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(tok)))
        df, low = np.repeat(n, n), np.repeat(sig[at], n)
        parts = frequent.value.parts(tok)
        df = np.where(parts > 1, np.minimum(np.maximum(np.maximum(df, parts * frequent.value.most), SMALL + 1), (1 << 31) - 1), df)
        many = np.flatnonzero(df > 1)
        for i in range(0, len(many), 1 << 18):
            m = many[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tok[m].view(np.int64)), pa.array(sig[m].view(np.int64)), *(pa.array(x[order[m]].astype(np.int32)) for x in (size, dem, weight)), pa.array(df[m].astype(np.int32)), pa.array(low[m].view(np.int64))],
                ["token", "node", "size", "demand", "weight", "df", "low"],
            )

    return run


def _whole_groups(batches, key: str):
    """Columns of each stretch of whole groups of rows sorted by ``key``, about a batch at a time."""
    rest: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        k = rb.column(key)
        if rest and k[0] == rest[-1].column(key)[-1] and k[0] == k[-1]:
            rest.append(rb)
            continue
        v = k.to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(v != v[-1])[-1]) + 1 if v[0] != v[-1] else 0
        rest.append(rb.slice(0, last))
        yield pa.Table.from_batches(rest)
        rest = [rb.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def _lists(postings: DataFrame, most: int) -> DataFrame:
    """list, node, size, weight: the posting lists, those of more than ``most`` nodes dealt into parts, and one more list of the most central node of each part."""
    parts = F.ceil(F.col("df") / most)
    rows = postings.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("list", F.when(F.col("parts") > 1, F.xxhash64("token", "part")).otherwise(F.col("token")))
    chief = F.max_by(F.struct("node", "size", "weight"), F.struct("weight", "node"))
    chiefs = rows.filter("parts > 1").groupBy("token", "part").agg(chief.alias("x")).select(F.xxhash64("token", F.lit(-1).cast("long")).alias("list"), "x.node", "x.size", "x.weight")
    return rows.select("list", "node", "size", "weight").unionByName(chiefs)


def _heads(t: tuple[int, int]):
    """(node, head, matches): each node with one node of its list that it may be similar to by length."""

    def run(batches):
        for tab in _whole_groups(batches, "list"):
            tok, sig, size = (tab.column(c).to_numpy() for c in ("list", "node", "size"))
            if not len(tok):
                continue
            group = np.concatenate(([0], np.cumsum(tok[1:] != tok[:-1])))
            left = np.arange(len(tok))
            got_n, got_h = [], []
            while len(left):  # the first left of each list heads all those in reach of its length
                g = group[left]
                first = np.concatenate(([True], g[1:] != g[:-1]))
                head = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
                near = np.minimum(size[left], size[head]) * np.int64(t[1]) >= np.maximum(size[left], size[head]) * np.int64(t[0])
                hit = near & (left != head)
                got_n.append(sig[left[hit]])
                got_h.append(sig[head[hit]])
                left = left[~near]
            pair = np.stack((np.concatenate(got_n), np.concatenate(got_h)), 1)
            pair, c = np.unique(pair, axis=0, return_counts=True) if len(pair) else (pair, np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(c.astype(np.int64))], ["a", "b", "c"])

    return run


def _across(t: tuple[int, int]):
    """(a, b, matches, demand) of pairs of different components and clusters within each short list."""

    def run(batches):
        for tab in _whole_groups(batches, "token"):
            key, node, size, dem, comp, cluster = (tab.column(c).to_numpy() for c in ("token", "node", "size", "demand", "comp", "cluster"))
            if not len(key):
                continue
            edge = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
            ends = np.repeat(edge[1:], np.diff(edge))
            out_a, out_b, out_d = [], [], []
            left = np.arange(len(key))
            for step in range(1, int(np.diff(edge).max(initial=0))):  # all lists at once, by distance in the list
                left = left[left + step < ends[left]]
                x, y = left, left + step
                ok = (comp[x] != comp[y]) & (cluster[x] != cluster[y])
                ok &= np.minimum(size[x], size[y]) * np.int64(t[1]) >= np.maximum(size[x], size[y]) * np.int64(t[0])
                x, y = x[ok], y[ok]
                out_a.append(node[x])
                out_b.append(node[y])
                out_d.append(np.minimum(dem[x], dem[y]))
            if out_a and sum(map(len, out_a)):
                pair = np.stack((np.concatenate(out_a), np.concatenate(out_b)), 1)
                pair, at, c = np.unique(pair, axis=0, return_index=True, return_counts=True)
                d = np.concatenate(out_d)[at]
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(c.astype(np.int64)), pa.array(d.astype(np.int64))], ["a", "b", "c", "d"])

    return run


def _blocks(n: int, t: tuple[int, int]):
    """(a, b) links that join components within each pair of blocks of a cluster.

    All overlaps of one document with the block come from one count over its tokens' lists.
    """

    def one(rows: pa.Table):
        node, comp, block = (rows.column(c).to_numpy() for c in ("s", "comp", "block"))
        over = _Overlaps(rows, n)
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        kinds, counts = np.unique(comp, return_counts=True)
        most = kinds[counts.argmax()]
        apart = block.min() != block.max()
        out_a, out_b = [], []
        for r in np.flatnonzero((comp != most) & over.keep).tolist():  # of two components one is not the largest
            ok = over.linked(r, t) & (comp != comp[r])
            if apart:
                ok &= block != block[r]
            for y in np.flatnonzero(ok).tolist():
                p, q = find(comp[r]), find(comp[y])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out_a.append(node[r])
                    out_b.append(node[y])
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return lambda batches: _by_group(batches, one)


def _by_group(batches, one, key: str = "g"):
    """``one`` of each group of rows, from rows sorted by their group."""
    held, now = [], None
    for rb in batches:
        k = rb.column(key).to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in zip(edge, edge[1:], strict=False):
            if e > s:
                if held and k[s] != now:
                    yield one(pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = k[s]
                held.append(rb.slice(s, e - s))
    if held:
        yield one(pa.Table.from_batches(held).combine_chunks())


class _Overlaps:
    """Overlaps of one set of a group with all others at once, by the lists of its tokens."""

    def __init__(self, rows: pa.Table, n: int):
        toks, sizes, keep = [], [], []
        node = rows.column("s").to_numpy()
        for a, b, tokens, edges in shingle_sets(rows.column("text").chunk(0), n):
            toks.append(tokens)
            sizes.append(np.diff(edges))
            keep.append(_signatures(tokens, edges).view(np.int64) == node[a:b])
        self.size, self.keep = np.concatenate(sizes), np.concatenate(keep)  # keep: not another text under the same id
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        seen, self.token = np.unique(np.concatenate(toks), return_inverse=True)
        order = np.argsort(self.token, kind="stable")
        self.lists = np.repeat(np.arange(len(self.size)), self.size)[order]
        self.at = np.searchsorted(self.token[order], np.arange(len(seen) + 1))

    def linked(self, r: int, t: tuple[int, int]) -> np.ndarray:
        """Which sets are similar enough to that of row r, itself included."""
        mine = self.token[self.begin[r] : self.begin[r + 1]]
        n = self.at[mine + 1] - self.at[mine]
        both = np.bincount(self.lists[np.repeat(self.at[mine], n) + spans(n)], minlength=len(self.size))
        return (both * t[1] >= (self.size + self.size[r] - both) * t[0]) & self.keep


def _count_links(n: int, t: tuple[int, int]):
    """(s, n): documents of other sets that each node links to, within each pair of blocks of a component."""

    def one(rows: pa.Table):
        node, times, block, own = (rows.column(c).to_numpy() for c in ("s", "times", "block", "own"))
        over, apart = _Overlaps(rows, n), block.min() != block.max()
        out = np.zeros(len(node), np.int64)
        for r in np.flatnonzero(over.keep).tolist():
            ok = over.linked(r, t)
            ok &= (block != block[r]) if apart else (node != node[r])
            out[r] = times[ok].sum()
        if not apart and not own[0]:
            out[:] = 0
        hit = np.flatnonzero(out)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(out[hit])], ["s", "n"])

    return lambda batches: _by_group(batches, one)


def link_counts(docs: DataFrame, every: DataFrame, of_node: DataFrame, id_col: str, text_col: str, n: int, t: tuple[int, int], few: int) -> DataFrame:
    """node, links: documents that a document of each node links to.

    Linked documents are of one component, so the sets of each component are compared block by block.  Nothing is
    emitted but one number a node and pair of blocks; the work grows with the square of a component's different sets.
    ``of_node``: node, doc, size, component.
    """
    buckets = bucket_count(docs.sparkSession, docs)
    times = every.filter("node is not null").groupBy("node").agg(F.count("*").alias("times"))
    member = of_node.join(times, "node")
    groups = member.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("many"), F.ceil(F.sum("size") / BLOCK_TOKENS).cast("int").alias("blocks")).filter("many > 1")
    m = member.join(groups, F.col("component") == F.col("c")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ship = cut(m.select("doc", F.col("node").alias("s"), "times", "block", (F.col("block") == F.col("other")).alias("own"), F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "size"), few)

    def counted(some: DataFrame) -> DataFrame:
        sent = texts_of(docs, some, id_col, text_col).select("g", "s", "times", "block", "own", "text")
        return map_arrow(sent.repartition(buckets, "g").sortWithinPartitions("g", "s"), _count_links(n, t), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))

    found = in_rounds(docs, ship, "g", few, counted).groupBy("s").agg(F.sum("n").alias("n"))
    return times.join(found, F.col("node") == F.col("s"), "left").select("node", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("links"))


def _verify(n: int, t: tuple[int, int]):
    def run(batches):
        head, held = None, None
        for rb in batches:
            node, dest = rb.column("s").to_numpy(), rb.column("dest").to_numpy()
            a_out, b_out, i_out, u_out = [], [], [], []
            for a, b, tokens, edges in shingle_sets(rb.column("text"), n):
                sig = _signatures(tokens, edges).view(np.int64)
                for i in range(a, b):
                    if sig[i - a] != node[i]:  # another text under the same id
                        continue
                    own = tokens[edges[i - a] : edges[i - a + 1]]
                    if node[i] == dest[i]:
                        head, held = dest[i], own.copy()
                        continue
                    if head != dest[i]:
                        raise ValueError("a member came before its head")
                    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    both = int((held[at] == own).sum())
                    union = len(held) + len(own) - both
                    if both * t[1] >= union * t[0]:
                        a_out.append(node[i])
                        b_out.append(dest[i])
                        i_out.append(both)
                        u_out.append(union)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(i_out, pa.int64()), pa.array(u_out, pa.int64())], ["a", "b", "inter", "uni"])

    return run


def texts_of(docs: DataFrame, ship: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``ship`` with the texts of its ``doc``; what a Bloom filter rules out is not shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(bloom.build(ship.select("doc"), "doc"))
    kind = dict(docs.dtypes)[id_col]

    def some(batches):
        for rb in batches:
            at = rb.column("at").flatten().to_numpy().reshape(-1, len(bloom.SEEDS))
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("text")], ["id", "text"]).filter(pa.array(bloom.may_hold(held.value, at)))

    texts = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), bloom.places(F.col(id_col)).alias("at")).filter("id is not null"), some, f"id {kind}, text string")
    return texts.join(ship, F.col("id") == F.col("doc"))


def rounds(docs: DataFrame, ship: DataFrame) -> int:
    """Into how many parts ``ship`` (with the ``size`` of each text) is cut so that the texts of one are at most ``SHIPPED`` of the input."""
    there = estimated_bytes(docs)
    if not there:
        return 1
    return max(1, -(-int((ship.agg(F.sum("size")).first()[0] or 0) * TOKEN_BYTES) // max(int(there * SHIPPED), 1)))


def in_rounds(docs: DataFrame, ship: DataFrame, key: str, few: int, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is ``made`` of all of ``ship``, part after part: rows of equal ``key`` stay together, and a part's texts leave the disk before the next part's are shipped."""
    spark, n, out = docs.sparkSession, rounds(docs, ship), []
    for i in range(n):
        part = ship if n == 1 else ship.filter(F.pmod(F.xxhash64(F.col(key), F.lit("round")), F.lit(n)) == i)
        out.append(write_shared(made(part).repartition(few), "round"))
        free(spark)
    return reduce(DataFrame.unionByName, out)


def verify(pairs: DataFrame, docs: DataFrame, holder: DataFrame, id_col: str, text_col: str, n: int, t: tuple[int, int], few: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough, with sizes of intersection and union.

    ``holder``: node, doc (one document of each node), size.  The texts of the nodes of
    ``a`` go to the keys of their ``b``; a key with many is salted.
    """
    spark = docs.sparkSession
    pairs = write_shared(pairs.select("a", "b").coalesce(few), "pairs")
    free(spark)
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    member = pairs.join(salts, "b").select(F.col("a").alias("s"), F.col("b").alias("dest"), F.pmod(F.xxhash64("a"), F.col("salts").cast("long")).cast("int").alias("salt"))
    own = salts.select(F.col("b").alias("s"), F.col("b").alias("dest"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    ship = cut(member.unionByName(own).join(holder, F.col("s") == F.col("node")).select("doc", "s", "dest", "salt", "size"), few)
    parts = bucket_count(spark, docs)

    def made(some: DataFrame) -> DataFrame:
        sent = texts_of(docs, some, id_col, text_col).select("s", "dest", "salt", "text")
        dealt = sent.repartition(parts, "dest", "salt").sortWithinPartitions("dest", "salt", (F.col("s") != F.col("dest")))
        return map_arrow(dealt, _verify(n, t), "a long, b long, inter long, uni long")

    return in_rounds(docs, ship, "dest", few, made)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (75, 100), links: bool = False) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable by links; with ``links`` also n_links, the documents it links to directly."""
    t, spark = threshold, docs.sparkSession
    few = few_parts(spark, docs)
    every = cut(nodes(docs, id_col, text_col, n), few, deal=True)
    holder = cut(every.filter("node is not null").groupBy("node").agg(F.min(id_col).alias("doc"), F.first("size").alias("size")), few)
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, id_col, text_col, n))
    free(spark)
    buckets = bucket_count(spark, docs)
    # rows with a null id have no postings: no pair needs a text that no id leads to
    found = map_arrow(docs.filter(F.col(id_col).isNotNull()).select(text_col), _postings(text_col, n, t, buckets, frequent), blobs.SCHEMA)
    postings = write_shared(map_arrow(blobs.deal(found, buckets), _shared_postings(frequent), POSTING), "postings")
    free(spark)

    heads = map_arrow(_lists(postings, LIST).repartition(buckets, "list").sortWithinPartitions("list", F.desc("weight"), "node"), _heads(t), "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    first = heads.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    near = verify(first, docs, holder, id_col, text_col, n, t, few)
    comp = cut(components(near, parts=few).withColumnRenamed("node", "v"), few)

    # nodes of long lists: clusters, compared block by block
    long = postings.filter(F.col("df") > SMALL)
    lows = long.filter(F.col("df") > LIST).select("token", "low").distinct()  # the parts of lists that were dealt out
    parts = lows.join(lows.groupBy("token").agg(F.min("low").alias("least")), "token").select(F.col("low").alias("a"), F.col("least").alias("b"))
    chain = long.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct().unionByName(parts)
    cluster = cut(components(chain, parts=few).select(F.col("node").alias("u"), F.col("component").alias("cluster")), few)
    members = cluster.join(comp, F.col("u") == F.col("v"), "left").select("u", "cluster", F.coalesce("component", "u").alias("comp"))
    members = members.join(holder, F.col("u") == F.col("node")).select("u", "cluster", "comp", "doc", "size")
    blocks = members.groupBy(F.col("cluster").alias("cl")).agg(F.ceil(F.sum("size") / BLOCK_TOKENS).cast("int").alias("blocks"), (F.min("comp") != F.max("comp")).alias("mixed")).filter("mixed")
    members = members.join(blocks, F.col("cluster") == F.col("cl")).withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks").cast("long")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ship = cut(members.select("doc", F.col("u").alias("s"), "comp", "block", F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "size"), few)

    def met(some: DataFrame) -> DataFrame:
        sent = texts_of(docs, some, id_col, text_col).select("g", "s", "comp", "block", "text")
        return map_arrow(sent.repartition(buckets, "g").sortWithinPartitions("g", "s"), _blocks(n, t), "a long, b long")

    dense = in_rounds(docs, ship, "g", few, met)

    # short lists: pairs of different components
    told = postings.filter(F.col("df") <= SMALL).join(comp, F.col("node") == F.col("v"), "left").join(cluster, F.col("node") == F.col("u"), "left").select(
        "token", "node", "size", "demand", F.coalesce("component", "node").alias("comp"), F.coalesce("cluster", "node").alias("cluster"))
    across = told.repartition(buckets, "token").sortWithinPartitions("token", "node")
    pairs = map_arrow(across, _across(t), "a long, b long, c long, d long").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("d").alias("d")).filter("c >= d")
    more = verify(pairs, docs, holder, id_col, text_col, n, t, few)

    final = components(near.select("a", "b").unionByName(more.select("a", "b")).unionByName(dense), parts=few)
    of_node = holder.join(final.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left").select("node", "doc", "size", F.coalesce("component", "node").alias("component"))
    least = of_node.groupBy("component").agg(F.min("doc").alias("component_id"))
    out = every.join(of_node.join(least, "component").select("node", "component_id"), "node", "left")
    more = []
    if links:
        out = out.join(link_counts(docs, every, cut(of_node, few), id_col, text_col, n, t, few), "node", "left")
        more = [F.coalesce("links", F.lit(0)).cast("long").alias("n_links")]
    return out.select(id_col, F.col("size").alias("n_shingles"), F.coalesce("component_id", id_col).alias("component_id"), *more)
