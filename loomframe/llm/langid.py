"""Language identification by interpolated Kneser-Ney character models.

Per language the characters' n-grams (n up to ``ORDER``) get interpolated
Kneser-Ney probabilities: the highest order from counts, the lower ones from
continuation counts, each with the absolute discount of its order, all estimated from
the full counts.  Then the model is pruned, and the back-off weights are set so that
each context's probabilities still sum to one.  The models of
all languages share sorted arrays of 64-bit n-gram hashes with one row of
log probabilities per n-gram; what an order lacks backs off to the next with that
context's weight.  A text gets the language of lowest cross-entropy per
character.  The score is the softmax over languages of the length-normalised
entropies at a fitted temperature, damped where the best entropy exceeds what the
learning texts of that language show (the calibrated rejection; ``reject`` tells
the entropy from which ``rejected`` is true).

Learning reads a sample of rows bounded by ``max_rows`` in expectation, chosen by a
hash of the id, the same share of rows a language.  N-grams are counted and weighed in the executors; about ``max_grams`` of each
order and language, the most frequent, reach the driver and are broadcast, so the model grows with the number of languages only.

Defined cases: null texts and texts without a letter are ``und`` with score 0; an
empty table gives no rows; without anything to learn from all texts are ``und``;
languages tie-break by name; rows that repeat an id, or have none, are told each for itself;
a very long text is read whole, in stretches of 65,536 characters; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, map_arrow, write_shared
from .textkernel import chunks, mix64, text_buffer

U = np.uint64
ORDER = 4
SPACE = 32


def _letters() -> np.ndarray:
    """Folded code of each character below 0x10000: letters lower-cased, all else one space."""
    out = np.full(0x10000, SPACE, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: np.ndarray | None = None


def characters(raw: bytes) -> np.ndarray:
    """Folded code points of UTF-8, runs of other than letters as one space."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    c = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = _TABLE[np.minimum(c, 0xFFFF)]
    high = np.flatnonzero(c > 0xFFFF)
    if len(high):
        seen, inv = np.unique(c[high], return_inverse=True)
        out[high] = np.array([x if chr(x).isalpha() else SPACE for x in seen.tolist()], np.uint32)[inv]
    return out


def prepared(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of these documents, each with a space on both sides, and the document of each."""
    # a separator that no document holds keeps them apart through decoding
    n = np.diff(off)
    joined = np.full(len(buf) + len(n), 0x0A, np.uint8)
    doc_of_byte = np.repeat(np.arange(len(n)), n)
    joined[np.arange(len(buf)) + doc_of_byte] = buf
    c = characters(joined.tobytes())
    lead = (joined & 0xC0) != 0x80
    at = np.cumsum(lead) - 1
    ends = at[off[1:] + np.arange(len(n))] if len(n) else np.empty(0, np.int64)
    doc = np.zeros(len(c), np.int64)
    if len(n) > 1:
        doc[ends[:-1] + 1] = 1
    doc = np.cumsum(doc)
    c[ends] = SPACE
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE) | (doc[1:] != doc[:-1])
    return c[keep], doc[keep]


def all_keys(c: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n = 0 .. order the keys of the n characters that end at each place (spaces stand before the first; none for 0)."""
    salt, base = U(0x5851F42D4C957F2D), U(0x9E3779B97F4A7C15)
    m = mix64(np.concatenate((np.full(order - 1, SPACE), c)).astype(np.uint64) + salt)
    raw, power, out = np.zeros(len(c), np.uint64), U(1), [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            raw = raw + m[order - n : order - n + len(c)] * power
            power = power * base
            out.append(mix64(raw ^ U(n)))
    return out


def gram_keys(c: np.ndarray, n: int) -> np.ndarray:
    """Key of the n characters that end at each place."""
    return all_keys(c, n)[n]


def _count(batches):
    """(lang, n, key, context key, shorter key, count) of each batch's n-grams."""
    for rb in batches:
        langs = np.array(rb.column("lang").to_pylist(), object)
        for name in sorted(set(langs.tolist())):
            buf, off = text_buffer(rb.column("text").filter(pa.array(langs == name)))
            for a, b in chunks(off, 4 << 20):
                c, doc = prepared(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                keys = all_keys(c)
                first = np.concatenate(([True], doc[1:] != doc[:-1]))
                for n in range(1, ORDER + 1):
                    key = keys[n]
                    whole = np.ones(len(c), bool)
                    for k in range(n - 1):  # n-grams that reach into the document before do not count
                        whole[k:] &= ~first[: len(first) - k]
                    key, at, count = np.unique(key[whole], return_index=True, return_counts=True)
                    at = np.flatnonzero(whole)[at]
                    context = keys[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
                    shorter = keys[n - 1][at] if n > 1 else np.zeros(len(at), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (key, context, shorter)), pa.array(count.astype(np.int64))],
                        ["lang", "n", "key", "context", "shorter", "count"],
                    )


class Model:
    """Sorted hash arrays: for each order the keys, and per language log probabilities and back-off weights."""

    def __init__(self, langs, keys, logp, back, base, mean, sd, temperature):
        self.langs, self.keys, self.logp, self.back, self.base = langs, keys, logp, back, base
        self.mean, self.sd, self.temperature = mean, sd, temperature

    def entropies(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character [documents, languages], and letters of each document."""
        n_docs = len(off) - 1
        c, doc = prepared(buf, off)
        total = np.zeros((n_docs, len(self.langs)))
        letters = np.bincount(doc[c != SPACE], minlength=n_docs)
        # spaces before each document, so that no context reaches into the one before
        place = np.arange(len(c)) + (doc + 1) * (ORDER - 1)
        padded = np.full(len(c) + n_docs * (ORDER - 1), SPACE, np.uint32)
        padded[place] = c
        step = 1 << 16
        for s in range(0, len(c), step):
            e = min(len(c), s + step)
            start = max(0, int(place[s]) - ORDER)
            part, at = padded[start : int(place[e - 1]) + 1], place[s:e] - start
            keys, lp = all_keys(part), np.zeros((e - s, len(self.langs)), np.float32)
            left = np.arange(e - s)
            for n in range(ORDER, 0, -1):
                key = keys[n][at[left]]
                i = np.minimum(np.searchsorted(self.keys[n], key), len(self.keys[n]) - 1)
                hit = self.keys[n][i] == key
                lp[left[hit]] += self.logp[n][i[hit]]
                left = left[~hit]
                if not len(left):
                    break
                if n > 1:  # weight of the context for what it has not seen
                    ctx = keys[n - 1][at[left] - 1]
                    j = np.minimum(np.searchsorted(self.keys[n - 1], ctx), len(self.keys[n - 1]) - 1)
                    known = self.keys[n - 1][j] == ctx
                    lp[left[known]] += self.back[n - 1][j[known]]
                else:
                    lp[left] += self.base
            d = doc[s:e]
            edge = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            total[d[edge]] -= np.add.reduceat(lp, edge, axis=0, dtype=np.float64)
        return total / np.maximum(np.bincount(doc, minlength=n_docs), 1)[:, None], letters

    def decide(self, h: np.ndarray, letters: np.ndarray, reject: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and rejection of each document."""
        best = h.argmin(1)
        z = np.exp(-(h - h.min(1, keepdims=True)) / self.temperature)
        p = z.max(1) / z.sum(1)
        odd = (h[np.arange(len(h)), best] - self.mean[best]) / self.sd[best]
        score = p / (1 + np.exp(np.clip(odd - reject, -30, 30)))
        lang = np.array(self.langs, object)[best]
        none = letters == 0
        lang[none], score[none] = "und", 0.0
        return lang, np.clip(score, 0.0, 1.0), (odd > reject) | none


def probabilities(grams: DataFrame) -> DataFrame:
    """lang, n, key, context, shorter, count, size and p: interpolated Kneser-Ney over *all* counted n-grams.

    The highest order uses counts, the lower ones continuation counts (at least 1, for what only begins texts).  Each order's
    discount is n1 / (n1 + 2 n2) of its full counts, so nothing is cut before the estimates.
    """
    left = grams.filter("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("shorter").alias("key")).agg(F.count("*").alias("left"))
    full = grams.join(left, ["lang", "n", "key"], "left")
    full = full.withColumn("c", F.when(F.col("n") == ORDER, F.col("count")).otherwise(F.greatest(F.coalesce("left", F.lit(1)), F.lit(1))).cast("double")).drop("left")
    n1, n2 = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    discount = full.groupBy("lang", "n").agg(F.when(n1 > 0, n1 / (n1 + 2 * n2)).otherwise(0.5).alias("d"))
    context = full.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    size = grams.filter("n = 1").agg((F.countDistinct("key") + 1).alias("size"))
    full = cut(full.join(F.broadcast(discount), ["lang", "n"]).join(context, ["lang", "n", "context"]).crossJoin(F.broadcast(size)))  # one row a language and order; one row
    own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
    rest = F.col("d") * F.col("kinds") / F.col("total")
    out = ["lang", "n", "key", "context", "shorter", "count", "size", "p"]
    done = [cut(full.filter("n = 1").withColumn("p", own + rest / F.col("size")).select(*out))]
    for n in range(2, ORDER + 1):
        low = done[-1].select("lang", F.col("key").alias("shorter"), F.col("p").alias("low"))
        done.append(cut(full.filter(F.col("n") == n).join(low, ["lang", "shorter"]).withColumn("p", own + rest * F.col("low")).select(*out)))
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    return whole


def pruned(probs: DataFrame, max_grams: int) -> DataFrame:
    """The ``max_grams`` most frequent n-grams of each order and language, and the contexts and suffixes of those kept.

    Probabilities stay those of the whole model; what is left out gets its share back through the back-off weights.
    """
    top = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "key"))
    ranked = cut(probs.withColumn("r", top))
    kept = ranked.filter((F.col("n") == ORDER) & (F.col("r") <= max_grams))
    above = kept
    for n in range(ORDER - 1, 0, -1):
        need = above.select("lang", F.col("shorter").alias("key")).unionByName(above.select("lang", F.col("context").alias("key"))).distinct().withColumn("needed", F.lit(True))
        above = ranked.filter(F.col("n") == n).join(need, ["lang", "key"], "left").filter((F.col("r") <= max_grams) | F.col("needed")).drop("needed")
        kept = kept.unionByName(above)
    return kept.drop("r")


def _arrays(tab: pa.Table) -> tuple:
    """Arrays of a model from rows of lang, n, key, context, shorter, size, p that hold every context and suffix."""
    coded = tab.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    code = np.searchsorted(langs, names)[coded.indices.to_numpy()]
    order = tab.column("n").to_numpy()
    keys, logp, back = [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1)
    size = tab.column("size")[0].as_py()
    base = np.zeros(len(langs), np.float64)
    prob: dict[int, np.ndarray] = {}
    weight: dict[int, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        t = np.flatnonzero(order == n)
        k, context, shorter = (tab.column(x).to_numpy()[t].view(np.uint64) for x in ("key", "context", "shorter"))
        own, lang = tab.column("p").to_numpy()[t], code[t]
        keys[n], first = np.unique(k, return_index=True)
        row = np.searchsorted(keys[n], k)
        p = np.full((len(keys[n]), len(langs)), np.nan)
        p[row, lang] = own
        if n == 1:
            seen = np.isfinite(p)
            base = np.maximum(1 - np.where(seen, p, 0).sum(0), 1e-9) / np.maximum(size - seen.sum(0), 1)
            lower = np.broadcast_to(base, p.shape)
        else:
            # the mass that a context's kept n-grams leave, over what the order below leaves for the others
            low = prob[n - 1][np.searchsorted(keys[n - 1], shorter), lang]
            at = np.searchsorted(keys[n - 1], context)
            used, shared = np.zeros(prob[n - 1].shape), np.zeros(prob[n - 1].shape)
            np.add.at(used, (at, lang), own)
            np.add.at(shared, (at, lang), low)
            weight[n - 1] = np.maximum(1 - used, 1e-9) / np.maximum(1 - shared, 1e-9)
            lower = weight[n - 1][np.searchsorted(keys[n - 1], context[first])] * prob[n - 1][np.searchsorted(keys[n - 1], shorter[first])]
        prob[n] = np.where(np.isfinite(p), p, lower)
        logp[n] = np.log(np.maximum(prob[n], 1e-12)).astype(np.float32)
    for n in range(1, ORDER + 1):
        back[n] = np.log(weight.get(n, np.ones(prob[n].shape))).astype(np.float32)
    return langs, keys, logp, back, np.log(base).astype(np.float32)


def fit(docs: DataFrame, may_learn: Column, max_rows: int = 12_000, max_grams: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n_rows = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), max_rows / F.count("*").over(Window.partitionBy()) / F.col("n"))  # one row a language
    share = write_shared(n_rows.withColumn("share", share).select(F.col("lang").alias("l"), "share"), "shares")  # so that Spark knows its size
    drawn = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    some = cut(rows.join(share, F.col("lang") == F.col("l")).filter(drawn).select("lang", "text"))
    grams = map_arrow(some, _count, "lang string, n int, key long, context long, shorter long, count long")
    grams = cut(grams.groupBy("lang", "n", "key").agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("count").alias("count")))
    tab = pruned(probabilities(grams), max_grams).select("lang", "n", "key", "context", "shorter", "size", "p").toArrow()
    if not tab.num_rows:
        return None
    parts = _arrays(tab)
    flat = Model(*parts, np.zeros(len(parts[0])), np.ones(len(parts[0])), 1.0)
    held = docs.sparkSession.sparkContext.broadcast(flat)

    def measure(batches):
        for rb in batches:
            buf, off = text_buffer(rb.column("text"))
            for a, b in chunks(off):
                h, letters = held.value.entropies(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                j = np.searchsorted(held.value.langs, np.array(rb.column("lang").slice(a, b - a).to_pylist(), object).astype(str))
                own = h[np.arange(b - a), j]
                rest = h.copy()
                rest[np.arange(b - a), j] = np.inf
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int64)), pa.array(own), pa.array(rest.min(1) - own), pa.array(letters.astype(np.int64))], ["j", "h", "gap", "letters"])

    got = map_arrow(some, measure, "j long, h double, gap double, letters long").filter("letters > 0").groupBy("j").agg(
        F.avg("h").alias("mean"), F.stddev_pop("h").alias("sd"), F.expr("percentile_approx(gap, 0.05)").alias("gap")).toPandas().sort_values("j")
    k = len(parts[0])
    mean, sd = np.full(k, got["mean"].mean() if len(got) else 0.0), np.ones(k)
    mean[got["j"]], sd[got["j"]] = got["mean"], np.maximum(got["sd"], 0.05)
    gap = got["gap"][np.isfinite(got["gap"])]
    return Model(*parts, mean, sd, float(max(gap.median(), 0.05)) / 3 if len(gap) else 0.1)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for rb in batches:
            buf, off = text_buffer(rb.column(text_col))
            for a, b in chunks(off):
                ids = rb.column(id_col).slice(a, b - a)
                if held.value is None:
                    lang, score, odd = ["und"] * (b - a), np.zeros(b - a), np.ones(b - a, bool)
                else:
                    lang, score, odd = held.value.decide(*held.value.entropies(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score), pa.array(odd)], [id_col, "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
