"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs of other scripts and accented letters to
plain ones and digits and signs to the letters they stand for; everything else
between words becomes one space.  The lexicon holds word beginnings, learned from
labelled rows: those clearly more frequent in toxic texts.  A hit inside an exception phrase does not count.  The summed weights are
divided by the length in words, and a logistic curve fitted on the same rows
turns that density into a score.

Learning reads a sample of labelled rows bounded by ``max_rows`` (in expectation;
chosen by a hash of the id), of equal texts with equal labels one.  Every word beginning of
the sample is weighed; the terms that pass, at most as many as the sample has, and the curve are all that is broadcast.

Defined cases: null and empty texts score as a text without hits; without toxic
rows to learn from the lexicon is empty and all scores are the base rate; labels
other than 0 and 1 and null ids are never learned from; of several labels of one id the larger counts;
terms of equal weight are ordered by name; rows that repeat an id, or have none, are scored each for itself;
a text is scored as a whole, however long; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, map_arrow

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнɡαεοριυνκτ", "aeopcyxijsdhkmtbhgaeopiuvkt", strict=True))
SUBSTITUTES = dict(zip("0134578@$", "oieastbas", strict=True))
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof")


def _fold_table() -> dict[int, str]:
    table = {}
    for c in (*range(0x41, 0x5B), *range(0xC0, 0x250)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
        if plain != chr(c):
            table[c] = plain
    for a, b in {**HOMOGLYPHS, **SUBSTITUTES}.items():
        table[ord(a)] = table[ord(a.upper())] = b
    return table


FOLD = _fold_table()
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words, each between spaces."""
    return f" {_GAP.sub(' ', (text or '').translate(FOLD)).strip()} "


#: Lengths of word beginnings that may become terms.
STEMS = (4, 5, 6, 7, 8)
#: Log odds from which a term counts as strong.
STRONG = 4.0


def stems(folded: str) -> Counter:
    """How often each word beginning occurs."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        for k in STEMS:
            if len(w) < k:
                break
            out[w[:k]] += n
    return out


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
        places: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for t, y in zip(rb.column("text").to_pylist(), rb.column("toxic").to_pylist(), strict=True):
            s = stems(fold(t))
            docs[y].update(s.keys())
            places[y].update(s)
        for y, seen in docs.items():
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([y] * len(names), pa.int32()), pa.array([seen[x] for x in names], pa.int64()), pa.array([places[y][x] for x in names], pa.int64())], ["stem", "toxic", "docs", "places"])


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions = weights, tuple(fold(x) for x in exceptions)
        self._auto = None

    def __reduce__(self):
        return (_lexicon, (self.weights, self.exceptions))

    def automaton(self):
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for w, x in self.weights.items():
                self._auto.add_word(f" {w}", (len(w), x))
            for e in self.exceptions:
                self._auto.add_word(e, (len(e) - 1, None))
            if len(self._auto):
                self._auto.make_automaton()
        return self._auto

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of each hit outside the exception phrases."""
        auto = self.automaton()
        if not len(auto):
            return []
        found, free = [], []
        for end, (n, x) in auto.iter(folded):
            if x is None:
                free.append((end - n, end))
            else:
                found.append((end - n + 1, x))
        return [f for f in found if not any(a < f[0] < b for a, b in free)] if free else found

    def density(self, text: str | None) -> tuple[float, float]:
        """Summed weight per 100 words, of strong terms and of the others."""
        f = fold(text)
        h = self.hits(f)
        words = max(1, f.count(" ") - 1)
        strong = sum(x for _, x in h if x >= STRONG)
        return (100.0 * strong / words, 100.0 * (sum(x for _, x in h) - strong) / words) if h else (0.0, 0.0)


def _lexicon(weights, exceptions):
    return Lexicon(weights, exceptions)


def learn_lexicon(rows: DataFrame, least: int = 3, share: float = 0.004, odds: float = 1.5, evidence: float = 8.0) -> Lexicon:
    """From rows of (text, toxic).

    A term's weight is the log odds of its rate per word.  It needs that weight, ``least``
    toxic texts (and a ``share`` of them), and ``evidence``: the log-likelihood ratio of its text counts.
    Of terms that begin one another the one that explains most is kept.  All word beginnings are
    counted and weighed; those with the weight reach the driver, at most as many as the sample has.
    """
    size = F.regexp_count("text", F.lit(r"\S+"))
    n = {r["toxic"]: (r["n"], r["w"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(size).alias("w")).collect()}
    (n_pos, w_pos), (n_neg, w_neg) = n.get(1, (0, 0)), n.get(0, (0, 0))
    least = max(least, int(share * n_pos))
    of = lambda c, y: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col(c))), F.lit(0))
    seen = map_arrow(rows.select("text", "toxic"), _count_stems, "stem string, toxic int, docs long, places long")
    seen = seen.groupBy("stem").agg(of("docs", 1).alias("d"), of("places", 1).alias("c"), of("docs", 0).alias("d0"), of("places", 0).alias("c0"))
    weight_of = F.log((F.col("c") + 0.5) / (w_pos + 1)) - F.log((F.col("c0") + 0.5) / (w_neg + 1))
    seen = seen.filter(F.col("d") >= least).withColumn("w", weight_of).filter((F.col("w") >= odds) & (F.col("d") / max(1, n_pos) > F.col("d0") / max(1, n_neg)))

    def ratio(a: float, n: float, b: float, m: float) -> float:
        p = (a + b) / (n + m)
        return sum(x * np.log(x / (k * p)) for x, k in ((a, n), (b, m)) if x) + sum((k - x) * np.log((k - x) / (k * (1 - p))) for x, k in ((a, n), (b, m)) if x < k)

    value, weight = {}, {}
    for r in seen.collect():
        if ratio(r["d"], n_pos, r["d0"], n_neg) >= evidence:
            value[r["stem"]], weight[r["stem"]] = ratio(r["c"], w_pos, r["c0"], w_neg), r["w"]
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for s in sorted(value, key=lambda s: (-value[s], s)):
        if s not in begun and not any(s[:k] in chosen for k in STEMS):
            chosen[s] = weight[s]
            begun.update(s[:k] for k in STEMS if k < len(s))
    return Lexicon(chosen)


def _features(strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(strong)), strong > 0, np.log1p(np.minimum(strong, 1000.0)), np.log1p(np.minimum(weak, 1000.0))), 1)


def fit_curve(strong: np.ndarray, weak: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    x, beta = _features(strong, weak), np.zeros(4)
    if not len(y):
        return np.array([-3.0, 3.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + 0.1 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), g)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray):
        self.lexicon, self.beta = lexicon, beta

    def score(self, texts: list[str | None]) -> np.ndarray:
        d = np.array([self.lexicon.density(t) for t in texts], np.float64).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(_features(d[:, 0], d[:, 1]) @ self.beta, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic) of a sample of about ``max_rows`` labelled rows at most, of equal texts with equal labels one."""
    y = labels.select(F.col(id_col).alias("k"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and k is not null").groupBy("k").agg(F.max("toxic").alias("toxic"))
    total = max(1, y.count())
    if total > max_rows:
        y = y.filter(F.pmod(F.xxhash64("k", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    rows = docs.filter(may_learn).select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(y, F.col("i") == F.col("k")).select("text", "toxic")
    return rows.filter("text is not null").withColumn("h", F.md5(F.col("text").cast("binary"))).dropDuplicates(["h", "toxic"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = 20_000, **cols) -> Model:
    rows = cut(labelled(docs, labels, may_learn, max_rows, **cols))
    lexicon = learn_lexicon(rows)
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        for rb in batches:
            d = [held.value.density(t) for t in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in d], pa.float64()), pa.array([x for _, x in d], pa.float64()), rb.column("toxic")], ["strong", "weak", "toxic"])

    got = map_arrow(rows, measure, "strong double, weak double, toxic int").toPandas()
    return Model(lexicon, fit_curve(got["strong"].to_numpy(), got["weak"].to_numpy(), got["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns, id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [id_col, *(c for c in keep if c != id_col)]
    kinds = dict(docs.dtypes)
    extra = [] if text_col in kept else [F.col(text_col)]

    def run(batches):
        for rb in batches:
            for a in range(0, rb.num_rows, 512):
                part = rb.slice(a, 512)
                s = held.value.score(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(s)], [*kept, "score"])

    return map_arrow(docs.select(*kept, *extra), run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double")
