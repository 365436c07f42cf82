"""A training-data pipeline over ``documents``: five stages, each written and reread as the next one's input.

``doc_id`` is the key of the table.  Every stage but the last returns the columns of ``documents``.

Defined cases, at every stage: null and empty texts stay (they hold no toxic word, no line, no shingle, no word and no piece); very
long texts are like any other; rows that repeat an id are kept or dropped each by its own text in the first two stages, go together with
their id in the third, share their turns in the fourth and are encoded each in the fifth; rows with a null id stay unless they are
toxic; ties are settled by the smaller id; extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import linededup, mixing, ngramjoin, pieces, toxicity
from loomframe.llm.queries import TOKENIZER
from loomframe.llm.tables import fold_of, table, write_shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, most: float = 0.7) -> DataFrame:
    """Documents below the toxicity score ``most``; the model learns from the labels of two folds of three."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return toxicity.score(docs, model, keep=COLUMNS).filter(F.col("score") < most).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, ratio: float = 0.01, least: int = 5) -> DataFrame:
    """Documents without the lines that stand in more than ``ratio`` of their source's different texts.

    The next stage needs copies and near copies whole, so a group's lines stay in one document at least.
    """
    out = linededup.drop_boilerplate(docs, host="source", text="text", ratio=ratio, least=least, keep=("doc_id", "lang"), copies="doc_id")
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    same = ngramjoin.join(docs)
    gone = same.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it.

    ``doc_id`` is the key.  Rows that repeat id, source and size share their turns: each gets the same number, rounded by a hash.
    """
    times = mixing.mix(docs).groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n")).agg(F.count("*").alias("m"), F.sum("times").cast("long").alias("all"))
    up = F.pmod(F.xxhash64("i", "s", "n", F.lit("mix")), F.col("m")) < F.col("all") % F.col("m")
    times = times.withColumn("times", (F.floor(F.col("all") / F.col("m")) + up.cast("int")).cast("int"))
    size = mixing.word_count(F.col("text"))
    held = docs.join(times.filter("times > 0"), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (size == F.col("n")))
    return held.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """doc_id, source, the pieces' ids, and digests of them and of the text that they decode to."""
    out = pieces.encode(docs, pieces.load(model), keep=("doc_id", "source"))
    return out.select("doc_id", "source", "ids", *pieces.summary(out))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Learning a lexicon and encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_shared(docs, f"pipeline-{name}")
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
