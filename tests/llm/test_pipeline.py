"""The pipeline on a small table, stage by stage against plain Python."""

import random
import re

import corpus_pipeline as P

from loomframe.llm import pieces


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("lor", "mit", "tun", "rex", "san")]
    rows, labels = [], []
    for i in range(200):
        w = [rng.choice(vocab) for _ in range(50)]
        toxic = i % 5 == 0
        if toxic:
            w[7] = "scumbag"
        text = ("Common footer line\n" if i % 2 else "") + " ".join(w)
        if i % 10 == 3:
            text = rows[-1][1].split("\n")[-1] + " tail"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, "", "en", None, 0), (901, None, None, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = docs, {}
    for name, stage in P.STAGES:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), stage(spark, d, str(tmp_path)).schema)
        seen[name] = d.collect()
        if name != P.STAGES[-1][0]:
            assert d.columns == list(P.COLUMNS)
    clean = {i for i, *_ in rows if not (i < 200 and i % 5 == 0)}
    assert {r.doc_id for r in seen["toxicity"]} == clean
    assert {r.doc_id for r in seen["line_dedup"]} == clean
    assert not any("Common footer" in (r.text or "") for r in seen["line_dedup"])

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    texts = {r.doc_id: shingles(r.text) for r in seen["line_dedup"]}
    gone = {a for a in texts for b in texts if b < a and texts[a] and texts[b] and len(texts[a] & texts[b]) * 100 >= 75 * len(texts[a] | texts[b])}
    assert {r.doc_id for r in seen["ngram_join"]} == clean - gone
    kept = sum(len((r.text or "").split()) for r in seen["ngram_join"])
    mixed = sum(len((r.text or "").split()) for r in seen["mixing"])
    assert abs(mixed - 1.5 * kept) <= 0.03 * kept
    assert len(seen["sentencepiece"]) == len(seen["mixing"])
    back = pieces.load(P.TOKENIZER)
    for r in seen["sentencepiece"][:20]:
        text = next(x.text for x in seen["mixing"] if x.doc_id == r.doc_id)
        import numpy as np

        assert back.decode(np.array(r.ids or [], int), np.array([0, len(r.ids or [])]))[0].decode() == (text or "")


def test_copies_keep_their_lines(spark, tmp_path):
    rng = random.Random(12)
    para = lambda n: "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(n))
    copy, near = para(8), para(8).split("\n")
    rows = [(i, para(3) + "\nSite footer", "en", "s", 0) for i in range(60)]
    rows += [(100 + i, copy, "en", "s", 0) for i in range(20)]
    rows += [(200 + i, "\n".join(f"{x} changed{i}" if k == i % 8 else x for k, x in enumerate(near)), "en", "s", 0) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = P.drop_lines(spark, docs, str(tmp_path))
    assert lines.count() == len(rows)
    left = {r.doc_id: r.text for r in P.drop_near_copies(spark, spark.createDataFrame(lines.collect(), docs.schema), str(tmp_path)).collect()}
    assert [(i, t) for i, t in left.items() if 100 <= i < 200] == [(100, copy)]
    assert not any("Site footer" in t for t in left.values())
    assert {x for i, t in left.items() if i >= 200 for x in t.split("\n")} >= set(near)
    assert left[200] == rows[80][1]
