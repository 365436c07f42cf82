"""Operators on documents against brute force, and their defined edge cases."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import components, langid, licenses, linededup, media, mixing, ngramjoin, pieces, substrings, tables, textkernel, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """(doc_id, text[, source]) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 7, "x", "y") for r in rows], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice((0, 1, 3, 4, 5, 13, 30, 120)))]
        if i % 7 == 3:
            w = w[: len(w) // 2] + passage.split() + w[len(w) // 2 :]
        if i % 5 == 4 and rows[-1][1]:
            w = rows[-1][1].split()
            for _ in range(rng.choice((0, 1, 2, 9))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, ("  " if i % 3 else "\n").join(w).replace("w1", "W1" if i % 2 else "w1")))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, rows[6][1]), (104, rows[6][1]), (105, "x " * 3000), (-5, rows[12][1]), (106, "é ü 你好  nbsp")]
    return rows


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    base = [f"b{i}" for i in range(60)]
    rng = random.Random(3)
    for i in range(90):  # a group of near copies large enough for long posting lists
        w = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            w[rng.randrange(60)] = f"z{i}"
        rows.append((200 + i, " ".join(w)))
    monkeypatch.setattr(ngramjoin, "SMALL", 16)
    monkeypatch.setattr(ngramjoin, "BLOCK_TOKENS", 1500)
    got = {r.doc_id: r for r in ngramjoin.join(frame(spark, rows), links=True).collect()}
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i, _ in rows]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(ids, links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in links) for i in ids}


def test_ngram_join_of_dealt_lists(spark, monkeypatch):
    """Long lists in several buckets and parts give the same classes."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(f"z{i}" if k == rng.randrange(50) else w for k, w in enumerate(base))) for i in range(120)] + corpus(5)[:30]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(list(sets), links)
    monkeypatch.setattr(ngramjoin, "SAMPLE", 2)
    monkeypatch.setattr(ngramjoin, "LIST", 10)
    monkeypatch.setattr(ngramjoin, "HOT", 2)
    got = {r.doc_id: r.component_id for r in ngramjoin.join(frame(spark, rows)).collect()}
    assert got == want


def test_tokens_are_counted_over_all_documents(spark, monkeypatch):
    """Counts are those of every document, in several frames and buckets, and each frequent token has its rank."""
    rows = corpus(7, 90)
    want = {}
    for _, text in rows:
        for _, _, tokens, _ in ngramjoin.shingle_sets(pa.array([text], pa.string()), 5):
            for h in tokens.tolist():
                want[h >> 16] = want.get(h >> 16, 0) + 1
    monkeypatch.setattr(ngramjoin, "PACKED", 300)
    got = {r.h: r.c for r in ngramjoin.token_counts(frame(spark, rows).repartition(3), "text", 5, 0, 7).collect()}
    assert got == want
    monkeypatch.setattr(ngramjoin, "RARE", 2)
    monkeypatch.setattr(ngramjoin, "LIST", 8)
    frequent = ngramjoin.frequent_tokens(frame(spark, rows), "doc_id", "text", 5)
    h = np.array(sorted(want), np.uint64) << np.uint64(16)
    c = np.array([want[x] for x in sorted(want)])
    true = np.where(c > 2, np.floor(np.log2(c)) + 1, 0)
    rank = frequent.ranks(h)
    assert max(want.values()) > 8 and (rank >= true).all() and (rank == true).mean() > 0.99
    monkeypatch.setattr(frequent, "hot", 1)
    assert (frequent.parts(h | rank << np.uint64(48)) == np.where(c > 8, -(-c // 8), 1)).all()


def test_ngram_join_ships_texts_in_rounds(spark, monkeypatch, tmp_path):
    """No step ships more than a share of the input at once, and the rounds together give all links."""
    rng = random.Random(6)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(60)]
        rows += [(len(rows) + k, " ".join(f"z{g}x{k}" if i == rng.randrange(60) else w for i, w in enumerate(base))) for k in range(rng.choice((1, 2, 5)))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    shipped, texts_of = [], ngramjoin.texts_of

    def recorded(docs, ship, *names):
        shipped.append(ship.agg({"size": "sum"}).first()[0] or 0)
        return texts_of(docs, ship, *names)

    monkeypatch.setattr(ngramjoin, "texts_of", recorded)
    monkeypatch.setattr(ngramjoin, "SHIPPED", 0.2)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngramjoin.join(docs, links=True).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(list(sets), links)
    assert got == {i: (want[i], sum(i in p for p in links)) for i in sets}
    at_once = max(shipped) * ngramjoin.TOKEN_BYTES / ngramjoin.estimated_bytes(docs)
    assert len(shipped) > 4 and at_once < 2 * 0.2  # shares of a round are dealt by a hash


def test_finished_steps_leave_no_shuffle_files(spark):
    """The shuffles of a written step are deleted at once, not when the driver happens to collect garbage."""

    def held():
        return set(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys().mkString(" ").split())

    before = held()
    kept = tables.write_shared(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(3, "k"), "free")
    assert held() - before
    tables.free(spark)
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert kept.count() == 10


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.join(frame(spark, [(1, None)]).limit(0)).count() == 0
    assert [tuple(r) for r in ngramjoin.join(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def test_ngram_join_of_null_ids(spark):
    base = [[f"g{k}w{i}" for i in range(40)] for k in range(8)]
    near = [" ".join([*w[:-1], "other"]) for w in base]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)] + [(None, t) for t in near] + [(None, " ".join(base[0])), (50, near[1])]
    got = sorted((tuple(r) for r in ngramjoin.join(frame(spark, rows)).collect()), key=str)
    want = [(k, 36, k) for k in range(8)] + [(50, 36, 1), (None, 36, 0), (None, 36, 1)] + [(None, 36, None)] * 7
    assert got == sorted(want, key=str)


def test_prefixes_demand_what_they_promise():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = (np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(2))
        both = np.intersect1d(x, y)
        if len(both) * 100 < 75 * len(np.union1d(x, y)):
            y = x[: int(len(x) * 0.9)]
        e = np.array([0, len(x), len(x) + len(y)])
        p, d = ngramjoin.prefixes(np.concatenate((x, y)), e, (75, 100))
        assert len(np.intersect1d(x[: p[0]], y[: p[1]])) >= min(d)


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for p in real for x in p}
    assert got == {k: v for k, v in closure(nodes, real).items()}


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus(2)
    got = {r.doc_id: r for r in substrings.dedup(frame(spark, rows)).collect()}
    first = {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert sum(s.n for s in got[i].spans) == len(gone)


def test_substring_dedup_keeps_null_ids_and_nothing(spark):
    text = " ".join(f"a{i}" for i in range(20))
    got = substrings.dedup(frame(spark, [(1, text), (None, text), (1, text)])).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]
    assert substrings.dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_windows_share_their_anchor():
    text = " ".join(f"t{i % 37}" for i in range(90))
    w = substrings.Windows(np.frombuffer((text + text).encode(), np.uint8), np.array([0, len(text), 2 * len(text)]))
    half = len(w.doc) // 2
    assert (w.whole[:half] == w.whole[half:]).all() and (w.anchor[:half] == w.anchor[half:]).all() and (w.place[:half] == w.place[half:]).all()


def test_windows_of_one_hash_are_compared_word_by_word():
    a, b = np.arange(13, dtype=np.uint64), np.arange(13, dtype=np.uint64) * np.uint64(7)
    h = np.concatenate((a, b, a, b, b))
    first = np.array([0, 13, 26, 39, 52])
    assert substrings.later(h, np.zeros(5, np.uint64), first, np.array([5, 4, 9, 4, 6])).tolist() == [False, False, True, False, True]


def test_substring_dedup_of_long_repeats(spark):
    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(300)}"
    passage = [word() for _ in range(30_000)]
    rows = [(3, " ".join(passage)), (1, " ".join([word() for _ in range(50)] + passage[100:25_000] + [word() for _ in range(50)])), (2, "\n".join(passage[5:17])), (7, "  ".join(passage[5:18]))]
    got = {r.doc_id: (r.n_words, r.n_removed, [tuple(x) for x in r.spans]) for r in substrings.dedup(frame(spark, rows)).collect()}
    assert got[1][1] == got[2][1] == 0
    assert got[3][2][0] == (100, 24_900) and got[7] == (13, 13, [(0, 13)])


def test_word_hashes_do_not_depend_on_place():
    text = ("alpha beta  gamma\nalpha " * 50).encode()
    s, e, _ = textkernel.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    h = textkernel.word_hashes(np.frombuffer(text, np.uint8), s, e)
    assert len(set(h.tolist())) == 3 and len(h) == 200


def test_license_counts_and_labels(spark):
    rows = [
        (1, "CC BY cc-by x All rights RESERVED"), (2, "GNU General  Public License, version 3. This work is licensed under the GNU General Public License, version 3."), (3, None), (4, "of the of the"),
        (5, "released under the fine mit license"), (6, "Kcc by"), (7, ""), (8, "é all rights reserved İ"), (8, "cc by"),
    ]
    got = {r.doc_id: r for r in licenses.summarise(frame(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert (got[2].n_base, got[2].first_word, got[2].base_labels) == (2, 1, "gpl") and "gpl-3.0" in got[2].labels
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert got[4].n_base == 0 and got[5].labels == "mit" and got[6].n_base == 0 and got[7].n_words == 0
    assert sorted(r.n_base for r in licenses.summarise(frame(spark, rows)).collect() if r.doc_id == 8) == [1, 1]
    assert licenses.summarise(frame(spark, rows).limit(0)).count() == 0


def test_license_rows_are_documents_of_their_own(spark):
    rows = [(1, "all rights reserved"), (1, "all rights reserved"), (2, "all rights x"), (2, "y rights reserved"), (None, "cc by"), (None, "cc by"), (None, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.base_labels) for r in licenses.summarise(frame(spark, rows)).collect()), key=str)
    want = [(1, 3, 1, "reserved")] * 2 + [(2, 3, 0, "")] * 2 + [(None, 2, 1, "cc-by")] * 2 + [(None, 0, 0, "")]
    assert got == sorted(want, key=str)


def test_license_spans_are_verified(spark):
    texts = ["of the " * 40, "of the " * 12, "under the " * 14, "the software " * 30]
    assert {(r.labels, r.score) for r in licenses.summarise(frame(spark, list(enumerate(texts)))).collect()} == {("", 0.0)}
    full = {i: (label, licenses.notice_words(t)) for i, (t, label) in enumerate(licenses.NOTICES.items()) if len(licenses.notice_words(t)) > 20}
    changed = {i: ["x" if k == 9 else x for k, x in enumerate(w)][:14] + ["put", "in"] + w[14:] for i, (_, w) in full.items()}
    rows = [(i, "word of the " * 5 + " ".join(w) + " of the end") for i, w in changed.items()]
    got = {r.doc_id: r for r in licenses.summarise(frame(spark, rows)).collect()}
    assert all(full[i][0] in got[i].labels.split(",") and got[i].score >= 0.75 for i in full)
    spans = licenses.scan(frame(spark, rows)).filter("not base").collect()
    assert all(r.first_word >= 0 and r.last_word > r.first_word for r in spans)


def test_mixing_reaches_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("x" * rng.choice((1, 2, 30, 90))), rng.choice(("a", "a", "a", "b", "c", None))) for i in range(300)] + [(900, None, "d"), (901, "", "d")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame(spark, rows[::-1])).collect()))
    per = {}
    for r in got:
        per.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.times * r.size
        assert 0 <= r.times <= 2
    total = sum(s for _, _, s in per.values())
    assert sum(t for t, _, _ in per.values()) == pytest.approx(1.5 * total)
    for t, taken, size in per.values():
        assert t <= 2 * size + 1e-9 and abs(taken - t) <= max(2, 0.02 * size)
    order = sorted((k for k in per if k is not None)) + [None]
    weight = dict(zip(order, [5, 2, 1, 5, 2], strict=False))
    free = [k for k in order if per[k][0] < 2 * per[k][2] - 1e-6]
    assert len({round(per[k][0] / weight[k], 6) for k in free}) <= 1
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_media_round_trip(spark):
    rows = [(1, "hello world " * 300), (2, ""), (3, None), (4, "x" * 576), (5, "é你好" * 1000), (6, "hello world " * 300), (None, "a")]
    got = media.read_avi(media.write_avi(frame(spark, rows)))
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, r)
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest())
        assert by[i].tail_crc32 == zlib.crc32(pay[-32:])
        assert sum(c.n_frames for c in by[i].clips) == by[i].n_frames == len(pay) // 576
    assert by[1].media_sha256 == by[6].media_sha256
    assert media.clip_rows(got).filter("start_s = 0").count() == len(rows)
    assert media.read_avi(media.write_avi(frame(spark, rows).limit(0))).count() == 0


def test_lossless_frames_and_shots():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, 576)).astype(np.uint8)
    x[:3] = 255
    x[5, ::2], x[5, 1::2] = 0, 255
    data, at = media.encode_frames(x)
    assert (media.decode_frames(data, at[:-1], np.diff(at)) == x).all()
    y = np.repeat(np.array([[10], [200]], np.uint8), 576, 1)[[0] * 6 + [1] * 6]
    hist = media.histograms(y.reshape(-1), np.arange(13) * 576)
    assert np.flatnonzero(media.shots(hist, np.zeros(12, int))).tolist() == [0, 6]
    samples, edges = media.Header(media.HEAD).decode([data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]), at
    assert (samples == x).all()


def foreign_frame(pixels, predictor):
    """A lossless JPEG of another size, predictor and code table (17 categories of 5 bits), bit by bit."""
    import struct

    h, w = pixels.shape
    bits = ""
    for y in range(h):
        for x in range(w):
            if y == 0 or x == 0:
                guess = int(pixels[0, x - 1]) if y == 0 and x else int(pixels[y - 1, 0]) if y else 128
            else:
                a, b, c = int(pixels[y, x - 1]), int(pixels[y - 1, x]), int(pixels[y - 1, x - 1])
                guess = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + ((b - c) >> 1), 6: b + ((a - c) >> 1), 7: (a + b) >> 1}[predictor]
            d = int(pixels[y, x]) - guess
            cat = abs(d).bit_length()
            bits += f"{cat:05b}" + (f"{d if d > 0 else d + (1 << cat) - 1:0{cat}b}" if cat else "")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    dht = bytes([0, 0, 0, 0, 0, 17, *[0] * 11, *range(17)])
    return b"".join((b"\xff\xd8\xff\xe0\0\4hi", b"\xff\xc4", struct.pack(">H", len(dht) + 2), dht, b"\xff\xc3", struct.pack(">HBHHB3B", 11, 8, h, w, 1, 1, 0x11, 0), b"\xff\xda", struct.pack(">HB2B3B", 8, 1, 1, 0, predictor, 0, 0), scan, b"\xff\xd9"))


def test_frames_of_other_writers():
    rng = np.random.default_rng(4)
    for predictor in range(1, 8):
        frames = [rng.integers(0, 256, (5, 7)).astype(np.uint8), np.full((5, 7), 200, np.uint8), rng.integers(100, 110, (3, 2)).astype(np.uint8)]
        raw = [foreign_frame(f, predictor) for f in frames]
        data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        samples, edges = media.decode(data, np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)
        assert [samples[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [f.reshape(-1).tolist() for f in frames]
    with pytest.raises(ValueError):
        media.Header(media.HEAD.replace(b"\xff\xc3", b"\xff\xc0"))


def plain_shots(frames):
    """Starts of shots of one file, frame by frame."""
    hist = [[sum(v // 16 == b for v in f) for b in range(16)] for f in frames]
    d = [0] + [sum(abs(x - y) for x, y in zip(p, q, strict=True)) for p, q in zip(hist, hist[1:], strict=False)] + [0]
    out = [0]
    for i in range(1, len(frames)):
        near = [d[j] for j in range(max(1, i - 4), min(len(frames), i + 5))]
        if 4 * d[i] >= len(frames[i]) and d[i] * len(near) > 1.5 * sum(near) and d[i] >= d[i - 1] and d[i] >= d[i + 1]:
            out.append(i)
    return out


def test_features_equal_a_plain_version(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(a) * rng.randrange(1, 40) for a in ("abc", "XYZ", "  .", "éß") for _ in range(rng.randrange(60))) for _ in range(25)]
    texts += ["long " * 250_000, "x" * 575, "y" * 577]
    got = {r.doc_id: r for r in media.read_avi(media.write_avi(frame(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        raw += b"\xff" * (-len(raw) % 576 if raw else 576)
        frames = [raw[k : k + 576] for k in range(0, len(raw), 576)]
        data, at = media.encode_frames(np.frombuffer(raw, np.uint8).reshape(-1, 576))
        lens = [b - a + len(media.HEAD) + 2 for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)]
        size = 12 + (12 + 64 + 12 + 64 + 48) + 12 + sum(8 + n + (n & 1) for n in lens) + 8 + 16 * len(lens)
        assert got[i].media_bytes == size
        if len(frames) < 400:
            assert [c.first_frame for c in got[i].clips] == plain_shots(frames)


def test_line_dedup(spark):
    head, foot = "Site menu", "All pages foot"
    rows = [(i, f"{head}\nunique {i}\n\n{foot if i % 2 else 'odd ' + str(i)}", "a") for i in range(10)] + [(20, f"{head}\nx", "b"), (21, None, "a"), (22, "", "a"), (23, f"{head}\n{head}", "a"), (24, "z", None)]
    got = {r.doc_id: r for r in linededup.drop_boilerplate(frame(spark, rows), host="source", text="text", ratio=0.3, least=3, keep=("doc_id", "size", "h")).collect()}
    assert got[1].text == "unique 1\n" and (got[1].n_lines, got[1].n_dropped) == (3, 2)
    assert got[2].text == "unique 2\n\nodd 2"
    assert got[20].text == f"{head}\nx" and got[21].text is None and got[22].text == "" and got[23].text == "" and got[24].text == "z"
    assert linededup.drop_boilerplate(frame(spark, rows).limit(0), host="source").count() == 0


def test_small_hosts_lose_their_boilerplate(spark):
    rows = [(i, f"menu\nown {i}", f"h{n}") for n in range(1, 7) for i in range(100 * n, 100 * n + n)]
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(frame(spark, rows), host="source", keep=("doc_id",)).collect()}
    assert got == {i: t if h == "h1" else f"own {i}" for i, t, h in rows}


def test_toxicity_learns_and_folds(spark):
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("lor", "mit", "tun", "rex")]
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(60)] = "vilewort" if i < 160 else rng.choice(("VILEWORTS", "v1lewort", "vіlеwort"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame(labels + [(None, 1), (999, None)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(docs, lab, F.col("doc_id") < 160)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [*rows, (500, None), (501, ""), (502, "vilewort"), (502, "ok")]), model, keep=("size",)).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, y in labels)
    assert got[500] == got[501] and got[500] < 0.5
    empty = toxicity.fit(docs.limit(0), lab, F.lit(True))
    assert 0 <= empty.score(["vilewort"])[0] <= 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_exception_phrases_do_not_count():
    lex = toxicity.Lexicon({"tras": 5.0}, ("trash can",))
    assert lex.density("a trash can here") == (0.0, 0.0) and lex.density("what trash")[0] > 0


def plain_density(lexicon, text):
    """Summed weights of strong and other terms per 100 words, word by word and term by term."""
    folded = toxicity.fold(text)
    inside = {k for e in lexicon.exceptions for a in range(len(folded)) if folded.startswith(e, a) for k in range(a + 1, a + len(e) - 1)}
    starts = [k + 1 for k in range(len(folded) - 1) if folded[k] == " " and folded[k + 1] != " "]
    hits = [x for k in starts if k not in inside for t, x in lexicon.weights.items() if folded.startswith(t, k)]
    strong = sum(x for x in hits if x >= toxicity.STRONG)
    n = max(1, len(folded.split()))
    return 100 * strong / n, 100 * (sum(hits) - strong) / n


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(12)
    vocab = ["trash", "trashy", "can", "clown", "fish", "vile", "vilest", "Idiot", "proof", "id1ot", "сlоwn", "plain", "words", "here", "tra$h", "ünïque", "über"]
    lexicon = toxicity.Lexicon({"tras": 2.5, "clow": 4.5, "vile": 6.0, "idio": 1.75, "idiot": 5.0})
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 25))) + rng.choice(("", ".", "!!", " 😀")) for _ in range(200)] + ["", None, "trash can trash can", "a trash  can-trash"]
    for t in texts:
        assert lexicon.density(t) == pytest.approx(plain_density(lexicon, t))
    rows = [(" ".join(rng.choice(vocab[:6] if i % 3 == 0 else vocab[6:]) for _ in range(12)) + f" u{i}", int(i % 3 == 0)) for i in range(90)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")).weights
    counts = {y: (sum(k == y for _, k in rows), sum(len(t.split()) for t, k in rows if k == y)) for y in (0, 1)}
    seen = {y: [toxicity.stems(toxicity.fold(t)) for t, k in rows if k == y] for y in (0, 1)}
    for term, weight in got.items():
        c1, c0 = (sum(s[term] for s in seen[y]) for y in (1, 0))
        assert weight == pytest.approx(math.log((c1 + 0.5) / (counts[1][1] + 1)) - math.log((c0 + 0.5) / (counts[0][1] + 1)))
        assert sum(term in s for s in seen[1]) >= 3
    assert not any(a != b and a.startswith(b) for a in got for b in got)
    everything = {x for s in seen[1] for x in s if sum(x in t for t in seen[1]) >= 10 and not any(x in t for t in seen[0])}
    assert all(any(x.startswith(t) or t.startswith(x) for t in got) for x in everything)


def test_language_id(spark):
    rng = random.Random(8)
    make = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(make[k]) for _ in range(5)) for _ in range(20)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame([(i, t, k, 1) for i, t, k in rows] + [(900, None, "aa", 1), (901, "123 ... 😀", "aa", 1), (902, "abcab", None, 1), (903, "", "bb", 1)], "doc_id long, text string, lang string, n int")
    model = langid.fit(df, F.col("doc_id") < 60)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == got[903].lang_pred == "und" and got[902].lang_pred == "aa"
    assert langid.fit(df.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def kneser_ney(texts, order):
    """Probability of a character after a context, interpolated, from raw counts."""
    grams = [{} for _ in range(order + 1)]
    for t in texts:
        for n in range(1, order + 1):
            for i in range(len(t) - n + 1):
                grams[n][t[i : i + n]] = grams[n].get(t[i : i + n], 0) + 1
    counts = [None, *[{g: max(1, sum(h[1:] == g for h in grams[n + 1])) if n < order else c for g, c in grams[n].items()} for n in range(1, order + 1)]]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        c = counts[len(g)]
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        after = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        return max(after.get(g, 0) - d, 0) / total + d * len(after) / total * p(g[1:])

    return p


def test_language_models_equal_brute_force(spark):
    texts = ["abracadabra abba", "bad cab dab", "a cad bab bad"]
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    shown = [f" {t} " for t in texts]
    c, doc = langid.prepared(*textkernel.text_buffer(pa.array(texts)))
    shown = ["".join(map(chr, c[doc == i].tolist())) for i in range(len(texts))]
    p = kneser_ney(shown, langid.ORDER)
    for text in ("abracadabra", "dab cab", "ccc ddd", "xyz ab"):
        buf, off = textkernel.text_buffer(pa.array([text]))
        c, _ = langid.prepared(buf, off)
        s = "".join(map(chr, c.tolist()))
        want = -sum(np.log(p((" " * langid.ORDER + s)[i + 1 : i + 1 + langid.ORDER])) for i in range(len(s))) / len(s)
        assert model.entropies(buf, off)[0][0, 0] == pytest.approx(want, rel=1e-4)


def test_pruned_language_models_still_sum_to_one(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aaabbcd ") for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    m = langid.fit(df, F.lit(True), max_grams=12)
    known = [ord(x) for x in "abcd "]
    for context in ("aaa", "abd", "dcd", "b a"):
        total = 0.0
        for x in [*known, ord("x")]:
            chars = np.array([ord(y) for y in context] + [x], np.uint32)
            lp = 0.0
            for n in range(langid.ORDER, 0, -1):
                key = langid.gram_keys(chars, n)[-1]
                i = np.searchsorted(m.keys[n], key)
                if i < len(m.keys[n]) and m.keys[n][i] == key:
                    lp += m.logp[n][i, 0]
                    break
                if n == 1:
                    lp += m.base[0]
                    break
                ctx = langid.gram_keys(chars, n - 1)[-2]
                j = np.searchsorted(m.keys[n - 1], ctx)
                if j < len(m.keys[n - 1]) and m.keys[n - 1][j] == ctx:
                    lp += m.back[n - 1][j, 0]
            total += np.exp(lp)
        assert total == pytest.approx(1.0, rel=1e-3)


def test_prepared_characters_keep_documents_apart():
    texts = ["Ab, c", "", "é1é", "...", "x"]
    buf, off = textkernel.text_buffer(pa.array(texts))
    c, doc = langid.prepared(buf, off)
    assert ["".join(map(chr, c[doc == i].tolist())).strip() for i in range(5)] == ["ab c", "", "é é", "", "x"]


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_pieces_equal_the_library(spark):
    import sentencepiece

    t = pieces.load(MODEL)
    texts = ["Hello world.\n  two  sp\tx é 你好 😀", "", " ", "\x00a", "▁x", "a" + " " * 50 + "b", "aaaaaaaaaaaaaa", "日本語", "<s> </s> <unk>", "1234567890" * 3, "The quick brown fox", "Ünïcödé straße…"]
    ids, begin = t.encode(texts, {})
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == want
    assert [x.decode() for x in t.decode(ids, begin)] == [x.replace("▁", " ") for x in texts]
    df = frame(spark, [*enumerate(texts), (90, None), (0, texts[0])])
    enc = pieces.encode(df, t)
    rows = enc.collect()
    assert {r.doc_id: r.decoded for r in rows if r.doc_id != 90} == {i: x.replace("▁", " ") for i, x in enumerate(texts)}
    assert [r.ids for r in rows if r.doc_id == 90] == [None]
    assert {(r.doc_id, r.text) for r in pieces.decode(enc, t).collect()} == {(r.doc_id, r.decoded) for r in rows}
    assert pieces.encode(df.limit(0), t).count() == 0


def test_pieces_equal_the_library_on_documents(spark):
    import sentencepiece

    t, lib = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choice("aeiou rstln  .,\n\t0123ÄßéЖ中文😀▁") for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    texts.append("Long text with a word " * 60_000)
    ids, begin = t.encode(texts, {})
    for i, x in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == lib.encode(x)
    assert [x.decode() for x in t.decode(ids, begin)] == [x.replace("▁", " ") for x in texts]


def test_unigram_shortest_path():
    t = pieces.Transducer([("a", -1.0), ("b", -1.0), ("ab", -1.5), ("abab", -5.0)], {}, "unigram")
    assert t.shortest_path("abab") == [2, 2]
    rng = random.Random(5)
    vocab = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | set("abc")
    t = pieces.Transducer([(p, -rng.random() * 5) for p in sorted(vocab)], {b: 100 + b for b in range(256)}, "unigram")
    score = dict(t.pieces)

    def best(s):
        if not s:
            return 0.0
        return min((best(s[k:]) - score[s[:k]] for k in range(1, len(s) + 1) if s[:k] in score), default=float("inf"))

    for _ in range(60):
        s = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
        got = t.shortest_path(s)
        assert "".join(t.pieces[i][0] for i in got) == s
        assert sum(-t.pieces[i][1] for i in got) == pytest.approx(best(s))


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
        elif isinstance(value, float):
            import struct

            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_model_rules_are_compiled():
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("<sep>", 0.0, 4), ("▁", -2.0, 1), ("a", -3.0, 1), ("▁a", -1.0, 1), ("b", -3.0, 1)]
    body = b"".join(message((1, message((1, p.encode()), (2, score), (3, kind)))) for p, score, kind in made)
    t = pieces.compile_model(body + message((2, message((3, 1)))) + message((3, message((3, 1), (4, 1)))))
    assert (t.kind, t.rules) == ("unigram", pieces.Rules(True, True, True))
    ids, begin = t.encode(["  a   a ", "a<sep>b", "axyb", ""], {})
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [[5, 5], [5, 2, 6], [5, 0, 6], []]
    with pytest.raises(ValueError):
        pieces.compile_model(body + message((3, message((2, b"map")))))
