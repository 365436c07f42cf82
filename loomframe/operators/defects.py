"""Known defects put into answers, what catches them, and what a second pass changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAIRS_PLAIN, REFERENCE, char_pairs, jaccard, let, numeral, references, trim_ws

#: What a fabricated number adds to the largest one, number words and what they become, phrases that no source has with their sentences, and the similarity below which a text cannot stand in for another.
FAKE_OFFSET = 777
SWAPS = (("八周岁", "十八周岁"), ("三十日", "九十日"), ("六十日", "三十日"), ("十五日", "六十日"), ("三年", "十年"), ("二年", "五年"), ("一年", "三年"), ("六个月", "十二个月"))
APPENDS = (
    ("人民调解委员会调解", "另外需要说明的是，此类纠纷必须先经人民调解委员会调解，未经调解不得直接向人民法院提起诉讼。"),
    ("仲裁前置", "另外需要说明的是，此类争议属于仲裁前置事项，未经仲裁不得向人民法院起诉。"),
    ("公示催告", "另外需要说明的是，权利人应当先向人民法院申请公示催告，催告期满后方可主张权利。"),
)
FAKE_SENTENCE = ("\n\n此外，根据《中华人民共和国民法典》第", "条，该情形还应当承担相应的法律责任。")
SEPARATOR = r"\n\n---\n\n"
DISSIMILAR = 0.15
KINDS = ("fabricated_cite", "distorted_number", "article_swap", "unsupported_append")


def blocks(context: Column) -> Column:
    """Array of (source, file, raw, number, body) of a formatted context; blocks without a source are left out."""

    def block(b: Column) -> Column:
        head = F.regexp_extract(b, r"^[^\n]*", 0)
        source, raw = (F.regexp_extract(head, name + r"：([^\s|]+)", 1) for name in ("来源", "条号"))
        body = trim_ws(F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)$", 1))
        number = numeral(F.nullif(F.regexp_extract(raw, REFERENCE, 1), F.lit("")))
        return F.struct(source.alias("source"), F.regexp_extract(source, "^[^#]*", 0).alias("file"), raw.alias("raw"), number.alias("number"), body.alias("body"))

    return F.filter(F.transform(F.split(context, SEPARATOR), block), lambda b: b["source"] != "")


def swap_target(df: DataFrame) -> DataFrame:
    """Adds ``start`` (number, spelling, file of the first reference that a block has) and ``goal``, the block to cite instead.

    The first block of another file, else the least similar one if it is dissimilar enough.  ``df``: refs, blocks.
    """
    held = F.filter("refs", lambda r: F.exists("blocks", lambda b: b["number"] == r["number"]))
    df = df.withColumn("origin", F.get(held, F.lit(0)))
    df = df.withColumn("own", F.get(F.filter("blocks", lambda b: b["number"] == F.col("origin.number")), F.lit(0)))
    df = df.withColumn("others", F.filter("blocks", lambda b: b["number"].isNotNull() & (b["number"] != F.col("origin.number"))))
    cross = F.get(F.filter("others", lambda b: b["file"] != F.col("own.file")), F.lit(0))
    far = F.array_min(F.transform("others", lambda b, i: F.struct(jaccard(char_pairs(F.col("own.body"), PAIRS_PLAIN), char_pairs(b["body"], PAIRS_PLAIN)).alias("sim"), i.alias("i"), b.alias("b"))))
    df = df.withColumn("cross", cross).withColumn("far", far)
    return df.withColumn("goal", F.coalesce("cross", F.when(F.col("far.sim") < DISSIMILAR, F.col("far.b"))))


def mutants(df: DataFrame, key: str, answer: str, context: str, corpus: str) -> DataFrame:
    """key, kind, needle, altered: answers with one known defect each, only where the text really changes."""
    a, c, whole = F.col(answer), F.col(context), F.col(corpus)
    d = df.withColumn("refs", references(a)).withColumn("blocks", blocks(c)).withColumn("most", F.array_max(F.transform(references(whole), lambda r: r["number"])))
    d = swap_target(d)
    fake = (F.col("most") + FAKE_OFFSET).cast("string")
    none = F.lit(None).cast("string")
    number = F.coalesce(*(F.when(F.contains(a, F.lit(x)) & F.contains(c, F.lit(x)), F.struct(F.lit(y).alias("needle"), F.replace(a, F.lit(x), F.lit(y)).alias("altered"))) for x, y in SWAPS))
    plain = F.concat(F.lit("第"), F.col("goal.number").cast("string"), F.lit("条"))
    spelled = F.when(F.regexp_like("origin.spelling", F.lit("^第[0-9]+条$")) | (F.col("goal.raw") == ""), plain).otherwise(F.col("goal.raw"))
    extra = F.coalesce(*(F.when(~F.contains(whole, F.lit(p)), F.struct(F.lit(p).alias("needle"), F.concat(a, F.lit("\n\n" + s)).alias("altered"))) for p, s in APPENDS))
    swapped = F.struct(F.when(F.col("goal").isNotNull(), spelled).alias("needle"), F.when(F.col("goal").isNotNull(), F.replace(a, F.col("origin.spelling"), spelled)).alias("altered"))
    made = F.struct(fake.alias("needle"), F.when(F.col("most") > 0, F.concat(a, F.lit(FAKE_SENTENCE[0]), fake, F.lit(FAKE_SENTENCE[1]))).otherwise(none).alias("altered"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("m")) for k, x in zip(KINDS, (made, number, swapped, extra), strict=True)))
    out = d.select(key, a.alias("a"), F.explode(kinds).alias("x")).select(key, "a", "x.kind", "x.m.needle", "x.m.altered")
    return out.filter(F.col("altered") != F.col("a")).select(key, "kind", "needle", "altered")


def needle_number(kind: Column, needle: Column) -> Column:
    """The number that an altered answer cites in place of the right one."""
    spelled = let(F.regexp_extract(needle, REFERENCE, 1), lambda s: numeral(F.nullif(s, F.lit(""))))
    return F.when(kind == "fabricated_cite", needle.try_cast("long")).when(kind == "article_swap", spelled)


def citation_catch(mutants: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Mutants with the status of the citation that was put in, whether the check caught it, and by the content rule.

    ``checks``: key, kind, number, status, i; of several checks of a number the first counts.
    """
    want = mutants.withColumn("number", needle_number(F.col("kind"), F.col("needle")))
    per = checks.groupBy(key, "kind", "number").agg(F.min_by("status", "i").alias("status"), F.bool_or(F.col("status") == "content_mismatch").alias("by_content"), F.bool_or(F.col("status") != "verified").alias("by_any"))
    hit = want.join(per, [key, "kind", "number"], "left")
    caught = F.when(F.col("kind") == "fabricated_cite", F.col("status") == "fabricated").when(F.col("kind") == "article_swap", F.col("status") != "verified")
    return hit.select(key, "kind", "needle", "number", "status", F.coalesce(caught, F.lit(False)).alias("caught"), F.coalesce("by_content", F.lit(False)).alias("by_content"), F.coalesce("by_any", F.lit(False)).alias("by_any"))


def merge_passes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The verdict after at most one second call: kept from the first unless the second is usable; costs are summed.

    ``first`` and ``second``: key, outcome, answerable, chunks, tokens, latency.  A second call counts only if its context is longer.
    """
    s = second.select(key, *(F.col(c).alias(f"_{c}") for c in ("outcome", "answerable", "chunks", "tokens", "latency")))
    j = first.join(s, key, "left")
    judged = ("judged", "binding_mismatch")
    asked = F.coalesce(F.col("outcome").isin(*judged) & (F.col("_chunks") > F.col("chunks")), F.lit(False))
    j = j.withColumn("second", asked).withColumn("use", F.col("second") & F.col("_outcome").isin(*judged))
    pick = lambda c: F.when(F.col("use"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    total = lambda c: (F.col(c) + F.when(F.col("second"), F.col(f"_{c}")).otherwise(0)).alias(c)
    return j.select(key, "second", pick("outcome"), pick("answerable"), pick("chunks"), total("tokens"), total("latency"))
