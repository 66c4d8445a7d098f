"""The corpus pipeline: toxicity, line dedup, near-duplicates, source mix and token ids, each stage on what the one
before it kept. Stages take (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.llm.line_dedup import dedup_lines
from tracehound.llm.minhash import near_duplicates
from tracehound.llm.mixing import mix_sources
from tracehound.llm.shared import near, spread, staged, table, text_or_empty
from tracehound.llm.toxicity import THRESHOLD, score_documents
from tracehound.llm.transducer import encode_digests

#: One or two lines of more words than this that stand elsewhere before are a repeated passage.
LONG_PASSAGE_WORDS = 50
#: Rows of one document that are made together.
LOT = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold. The classifier learns from the labelled rows of docs. Null and empty
    texts get the score of no words; repeated rows are scored alike, and rows without doc_id are scored too."""
    scored = score_documents(docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row")), table(spark, sf_dir, "labels"), keep=("__row",))
    return scored.filter(F.col("score") < THRESHOLD).select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere before; a document of which nothing is left goes. n_chars follows.
    Null and empty texts stay as they are, equal rows (doc_id and text) are one document and treated alike, and rows
    without doc_id stand before all others."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", *([F.struct(*rest).alias("__rest")] if rest else []))
    cut = dedup_lines(own, long_words=LONG_PASSAGE_WORDS)
    left = cut.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    left = left.select("doc_id", "text", F.col("n_removed").alias("__removed"), *(["__rest.*"] if rest else []))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__removed") == 0, F.col("n_chars")).otherwise(F.char_length("text"))
        left = left.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def _keyed(docs: DataFrame, *keys: str) -> DataFrame:
    """docs with __text, the text's hash, and a __<key> for each of the others: what makes a document, besides columns
    that no stage looks at."""
    return docs.withColumns({"__text": F.xxhash64(text_or_empty()), **{f"__{k}": F.col(k) for k in keys}})


def _one_of_each(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs with one row for each combination of keys: of several the one of the least hash over all columns."""
    repeated = staged(docs.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n"), "pipeline-repeated")
    n = repeated.count()
    if n == 0:
        return docs
    sent = near(repeated.withColumnsRenamed({k: f"{k}_r" for k in keys}), n)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys]
    row = F.struct(*docs.columns)
    few = docs.join(sent, same, "left_semi").groupBy(*keys).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row")).select("__row.*")
    return docs.join(sent, same, "left_anti").unionByName(few)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, and of the least text hash where
    several texts have that id. Equal rows, and rows that differ in other columns only, are copies too. Documents without
    doc_id stay."""
    found = near_duplicates(docs)
    gone = staged(found.filter("not first").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "pipeline-gone")
    rows = _keyed(docs, "doc_id")
    kept = rows.join(near(gone, gone.count()), (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti")
    one = _one_of_each(kept.filter(F.col("doc_id").isNotNull()), ["__doc_id", "__text"])
    return one.unionByName(kept.filter(F.col("doc_id").isNull())).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often (0 to 2 times) as the mix takes them; documents without words stay. A source of which
    no document begins in a taken block, though it has a target, keeps its shortest one. Rows with one doc_id, source
    and text are one document that stands several times."""
    rows = _keyed(docs, "doc_id", "source")
    keys = ["__doc_id", "__source", "__text"]
    mixed = mix_sources(rows, whole=True, keep=("__source", "__text"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1))))
    mixed = mixed.select(F.col("doc_id").alias("__doc_id"), "__source", "__text", "size", "target", times.alias("times"))
    mixed = staged(mixed.groupBy(*keys, "size", "target").agg(F.sum("times").alias("times")), "pipeline-mixed")
    sized = mixed.filter("size > 0 and target > 0")
    # Source by source, not document by document: one row of each source that lost all.
    lost = sized.groupBy("__source").agg(F.max("times").alias("most"), F.min(F.struct("size", "__doc_id", "__text")).alias("least")).filter("most = 0")
    lost = lost.select("least.__doc_id", "__source", "least.__text", F.lit(1).cast("long").alias("times"))
    taken = mixed.filter("times > 0").select(*keys, "times").unionByName(lost).withColumnsRenamed({k: f"{k}_t" for k in keys})
    taken = staged(taken, "pipeline-times")
    out = _one_of_each(rows, keys).join(near(taken, taken.count()), [F.col(k).eqNullSafe(F.col(f"{k}_t")) for k in keys])
    # As many rows as the document is taken, in lots, so that one that stands in a third of the rows is spread again.
    lots = out.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / LOT))))
    again = F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT), F.col("times") - F.col("__lot") * LOT))
    return lots.withColumn("__n", F.explode(again)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of the ids and of the decoded text of each document of the mix; null and
    empty texts have no tokens and the digests of nothing."""
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", tokens),
]

#: A trained classifier, a minimum over random hashes and BPE merging are not to be had in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
