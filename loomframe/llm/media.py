"""Media columns: motion JPEG in AVI.

``write_avi`` stores each payload as 24 x 24 grey frames, one byte a sample, in
lossless JPEG (SOF3, predictor 1) inside a RIFF/AVI container with an ``idx1``
index.  ``read_avi`` parses the RIFF chunks and the index, decodes every intra
frame by the tables, size and predictor that its own header states, and detects shots by adaptive histogram differences.  ``clip_rows`` yields
one timed row per shot.

Both directions are vectorised over the frames of a batch: symbols are packed
with prefix sums of their lengths, and all frames with one header are decoded in step, one
sample of each at a time.  Frames of other writers are read if they are lossless JPEG of one
8-bit component; lossy (DCT) frames and restart intervals are refused with an error.

Defined cases: a null text is an empty one; an empty text still has one frame
(all 255); a very long text is one file, held by one task; ties (of neighbouring histogram distances) open
a shot at each; repeated rows give equal values; extra columns are dropped,
the id column is carried as it is, null included; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow
from .textkernel import chunks, spans, text_buffer

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Huffman code of the nine difference categories: seven of 3 bits, one of 4, one of 5.
CATEGORIES = ((3, (0, 2, 3, 4, 5, 6, 7)), (4, (1,)), (5, (8,)))
BINS = 16


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value and length of each difference's symbol; difference and length by the next 13 bits."""
    codes, code, last = {}, 0, 0
    for length, cats in CATEGORIES:
        code <<= length - last if last else 0
        for c in cats:
            codes[c] = (code, length)
            code += 1
        last = length
    value, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    decode = np.zeros(1 << 13, np.int32)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << cat) - 1
        code, length = codes[cat]
        value[d + 255], size[d + 255] = code << cat | extra, length + cat
        free = 13 - length - cat
        at = int(value[d + 255]) << free
        decode[at : at + (1 << free)] = (length + cat) << 16 | (d + 255)
    return value, size, decode


VALUE, SIZE, DECODE = _code_tables()


def _jpeg_head() -> bytes:
    counts = [0] * 16
    for length, cats in CATEGORIES:
        counts[length - 1] = len(cats)
    values = [c for _, cats in CATEGORIES for c in cats]
    dht = bytes([0, *counts, *values])
    return b"".join(
        (
            b"\xff\xd8",
            b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0),
            b"\xff\xc4" + struct.pack(">H", len(dht) + 2) + dht,
            b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0),
        )
    )


HEAD = _jpeg_head()


def encode_frames(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded and stuffed scans of uint8 [n, 576]: their bytes, and n + 1 offsets."""
    n = len(frames)
    x = frames.reshape(n, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    sym = d.reshape(-1) + 255
    size = SIZE[sym]
    bits = size.reshape(n, FRAME).sum(1)
    lengths = (bits + 7) >> 3
    base = np.concatenate(([0], np.cumsum(lengths)))
    ends = np.cumsum(size)
    before = np.concatenate(([0], np.cumsum(bits)))[:-1]
    at = ends - size + np.repeat(base[:-1] * 8 - before, FRAME)
    window = VALUE[sym] << (24 - size - (at & 7))
    byte = at >> 3
    total = int(base[-1])
    out = np.bincount(byte, window >> 16, total + 2)
    out += np.bincount(byte + 1, window >> 8 & 255, total + 2)
    out += np.bincount(byte + 2, window & 255, total + 2) if total > 0 else 0
    out = out[:total].astype(np.uint8)
    out[base[1:] - 1] |= ((1 << (lengths * 8 - bits)) - 1).astype(np.uint8)
    full = out == 255
    stuffed = np.zeros(total + int(full.sum()), np.uint8)
    shift = np.cumsum(full)
    stuffed[np.arange(total) + shift - full] = out
    return stuffed, base + np.concatenate(([0], shift))[base]


def decode_frames(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """uint8 [n, 576] of the stuffed scans at these places."""
    n = len(starts)
    scan = data[np.repeat(starts, lengths) + spans(lengths)]
    keep = np.ones(len(scan), bool)
    keep[1:] = (scan[1:] != 0) | (scan[:-1] != 255)
    ends = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(lengths)))]
    b = np.concatenate((scan[keep], np.zeros(3, np.uint8))).astype(np.int32)
    window = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    pos = ends[:-1] * 8
    out = np.empty((FRAME, n), np.int16)
    for i in range(FRAME):
        got = DECODE[window[pos >> 3] >> (11 - (pos & 7)) & 0x1FFF]
        out[i] = got & 0xFFFF
        pos = pos + (got >> 16)
    if n and not ((pos + 7 >> 3) == ends[1:]).all():
        raise ValueError("a scan does not end with its last sample")
    out = out.reshape(SIDE, SIDE, n) - np.int16(255)
    out[:, 0] = np.cumsum(out[:, 0], 0, dtype=np.int16) + 128
    return np.cumsum(out, 1, dtype=np.int16).astype(np.uint8).reshape(FRAME, n).T


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_bytes(scans: list[bytes]) -> bytes:
    """A RIFF/AVI file of one motion-JPEG stream."""
    frames = [HEAD + s + b"\xff\xd9" for s in scans]
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    lens = np.fromiter(map(len, frames), np.int64, n)
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, lens
    index["at"] = 4 + np.concatenate(([0], np.cumsum(8 + lens + (lens & 1))))[:-1]
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes()))


def parse_riff(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Absolute starts and sizes of the indexed frames of stream 0."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF/AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    index = index[index["id"] == b"00dc"]
    return movi + index["at"].astype(np.int64) + 8, index["size"].astype(np.int64)


def parse_frame(frame: bytes) -> tuple[bytes, int, int]:
    """Header up to its scan, and where the entropy-coded data begin and end."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while frame[at : at + 1] == b"\xff":
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            end = at
            while True:
                end = frame.find(b"\xff", end)
                if end < 0:
                    return frame[:at], at, len(frame)
                if frame[end + 1 : end + 2] not in (b"\0", b""):
                    return frame[:at], at, end
                end += 2
    raise ValueError("a frame without a scan")


class Header:
    """Size, predictor and code table that a frame's header states."""

    def __init__(self, head: bytes):
        at, tables, chosen = 2, {}, None
        while at < len(head):
            marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + size]
            if marker == 0xC3:
                precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or n != 1:
                    raise ValueError("only frames of one 8-bit component are read")
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    tables[body[0]] = (counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only lossless JPEG frames are read")
            elif marker == 0xDD and body != b"\0\0":
                raise ValueError("restart intervals are not read")
            elif marker == 0xDA:
                chosen, self.predictor, self.shift = body[2] >> 4, body[3], body[5] & 15
            at += 2 + size
        counts, values = tables[chosen]
        self.code = np.zeros(1 << 16, np.int64)
        code = k = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                first = code << (16 - length)
                self.code[first : first + (1 << (16 - length))] = length << 8 | values[k]
                code, k = code + 1, k + 1
            code <<= 1

    def decode(self, scans: list[bytes]) -> np.ndarray:
        """uint8 [n, height * width] of these entropy-coded scans."""
        n, many = len(scans), self.height * self.width
        raw = [x.replace(b"\xff\0", b"\xff") + bytes(5) for x in scans]
        start = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        window = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]
        pos, diff = start[:-1] * 8, np.empty((many, n), np.int64)
        for i in range(many):
            w, off = window[np.minimum(pos >> 3, len(window) - 1)], pos & 7
            got = self.code[w >> (24 - off) & 0xFFFF]
            length, cat = got >> 8, got & 255
            bits = np.where(cat == 16, 0, cat)
            extra = w >> (40 - off - length - bits) & ((1 << bits) - 1)
            diff[i] = np.where(cat == 0, 0, np.where(cat == 16, 1 << 15, np.where(extra >> np.maximum(cat - 1, 0) > 0, extra, extra - (1 << bits) + 1)))
            pos = pos + length + bits
        if (length == 0).any() or not ((pos + 7 >> 3) == start[1:] - 5).all():
            raise ValueError("a scan does not end with its last sample")
        out = np.zeros((self.height, self.width, n), np.int64)
        diff = diff.reshape(out.shape)
        for y in range(self.height):
            for x in range(self.width):
                if y == 0 or x == 0:
                    guess = out[0, x - 1] if y == 0 and x else out[y - 1, 0] if y else 1 << (7 - self.shift)
                else:
                    left, up, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                    guess = (0, left, up, corner, left + up - corner, left + (up - corner >> 1), up + (left - corner >> 1), left + up >> 1)[self.predictor]
                out[y, x] = guess + diff[y, x] & 0xFFFF
        return (out << self.shift).astype(np.uint8).reshape(many, n).T


def decode(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of these frames one after another, and each frame's first and the end."""
    head = np.frombuffer(HEAD, np.uint8)
    if not len(starts) or ((sizes > len(head)).all() and (data[starts[:, None] + np.arange(len(head))] == head).all()):
        frames = decode_frames(data, starts + len(head), sizes - len(head) - 2)
        return np.ascontiguousarray(frames).reshape(-1), np.arange(len(starts) + 1) * FRAME
    by: dict[bytes, list[int]] = {}
    scans = []
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        frame = data[a : a + n].tobytes()
        key, begin, end = parse_frame(frame)
        by.setdefault(key, []).append(i)
        scans.append(frame[begin:end])
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(scans)
    for key, rows in by.items():
        for i, x in zip(rows, Header(key).decode([scans[i] for i in rows]), strict=True):
            out[i] = np.ascontiguousarray(x)
    return np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))


def histograms(samples: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Counts of each frame's samples in ``BINS`` equal bins."""
    n = len(edges) - 1
    frame = np.repeat(np.arange(n), np.diff(edges))
    return np.bincount(frame * BINS + (samples >> 4), minlength=n * BINS).reshape(n, BINS)


def shots(hist: np.ndarray, owner: np.ndarray, k: float = 1.5, radius: int = 4) -> np.ndarray:
    """True where a shot starts.

    A frame opens one if it is the first of its file, or if its histogram's L1
    distance to the frame before is at least a quarter of the samples, exceeds
    ``k`` times the mean distance within ``radius`` frames of the same file, and
    is no smaller than either neighbour's.
    """
    n = len(hist)
    first = np.ones(n, bool)
    if n < 2:
        return first
    first[1:] = owner[1:] != owner[:-1]
    d = np.zeros(n, np.int64)
    d[1:] = np.abs(hist[1:] - hist[:-1]).sum(1)
    d[first] = 0
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    stop = np.append(np.flatnonzero(first)[1:], n)[np.cumsum(first) - 1]
    lo, hi = np.maximum(np.arange(n) - radius, begin + 1), np.minimum(np.arange(n) + radius + 1, stop)
    total = np.concatenate(([0], np.cumsum(d)))
    count = np.maximum(hi - lo, 1)
    left, right = np.append(0, d[:-1]), np.append(d[1:], 0)
    return first | ((d * 4 >= hist.sum(1)) & (d * count > k * (total[hi] - total[np.minimum(lo, hi)])) & (d >= left) & (d >= right))


def _write(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(text_col))
            ids = batch.column(id_col)
            for a, b in chunks(off):
                size = np.diff(off[a : b + 1])
                n_frames = np.maximum((size + FRAME - 1) // FRAME, 1)
                edges = np.concatenate(([0], np.cumsum(n_frames)))
                pay = np.full(int(edges[-1]) * FRAME, 255, np.uint8)
                pay[np.repeat(edges[:-1] * FRAME, size) + spans(size)] = buf[off[a] : off[b]]
                data, at = encode_frames(pay.reshape(-1, FRAME))
                data = data.tobytes()
                scans = [data[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                files = [avi_bytes(scans[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    return run


def write_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: every text's UTF-8 bytes, padded with 255, as an AVI file."""
    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), _write(id_col, text_col), f"`{id_col}` {kind}, n_bytes long, media binary")


def _read(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("media")).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in chunks(np.concatenate(([0], np.cumsum(sizes)))):
                files = batch.column("media").slice(a, b - a).to_pylist()
                places = [parse_riff(f) for f in files]
                base = np.concatenate(([0], np.cumsum([len(f) for f in files])))
                counts = np.fromiter((len(p[0]) for p in places), np.int64, len(places))
                owner = np.repeat(np.arange(len(files)), counts)
                data = np.frombuffer(b"".join(files), np.uint8)
                samples, at = decode(data, np.concatenate([p[0] for p in places]) + base[owner], np.concatenate([p[1] for p in places]))
                cut = shots(histograms(samples, at), owner)
                edges = np.concatenate(([0], np.cumsum(counts))).tolist()
                payload = samples.tobytes()
                rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "clips")}
                for i, f in enumerate(files):
                    own = payload[int(at[edges[i]]) : int(at[edges[i + 1]])]
                    opens = np.flatnonzero(cut[edges[i] : edges[i + 1]])
                    ends = np.append(opens[1:], edges[i + 1] - edges[i])
                    rows["payload_bytes"].append(len(own))
                    rows["payload_sha256"].append(hashlib.sha256(own).hexdigest())
                    rows["tail_crc32"].append(zlib.crc32(own[-32:]))
                    rows["media_bytes"].append(len(f))
                    rows["media_sha256"].append(hashlib.sha256(f).hexdigest())
                    rows["n_frames"].append(edges[i + 1] - edges[i])
                    rows["clips"].append([{"first_frame": s, "n_frames": e - s} for s, e in zip(opens.tolist(), ends.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(a, b - a), batch.column("n_bytes").slice(a, b - a), *(pa.array(rows[k], t) for k, t in zip(rows, _KINDS, strict=True))],
                    [id_col, "n_bytes", *rows],
                )

    return run


_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("first_frame", pa.int64()), ("n_frames", pa.int64())])))


def read_avi(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from each file: digests of payload and file, and its shots in ``clips``."""
    kind = dict(media.dtypes)[id_col]
    return map_arrow(
        media.select(id_col, "n_bytes", "media"),
        _read(id_col),
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, "
        "clips array<struct<first_frame: long, n_frames: long>>",
    )


def clip_rows(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per shot, with its times in seconds."""
    return read.select(id_col, F.posexplode("clips").alias("clip", "c")).select(
        id_col, "clip", "c.first_frame", "c.n_frames", (F.col("c.first_frame") / FPS).alias("start_s"), ((F.col("c.first_frame") + F.col("c.n_frames")) / FPS).alias("end_s")
    )
