"""A training-data pipeline over `documents`: each stage reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, jaccard, langid, pieces, suffix_dedup
from larkspur.llm.scratch import written

#: Least posterior of a document's best language.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised.

    Null texts and texts without a letter go; repeated rows are judged alike, ties between languages go to the smaller
    name; texts of any length are read whole; other columns stay as they are, also those named like a result; without
    labelled rows none is left.
    """
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score")}  # columns named like a result
    judged = langid.identify(docs.withColumnsRenamed(aside), model)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component of near copies: five-word shingles, similarity 0.8 or more.

    Documents without words are kept, null texts too; of rows that share a kept doc_id all stay, and all go where one
    of them goes; rows without doc_id stay. A table of any size is cut by the written list of those that go.
    """
    linked = jaccard.link_components(docs.select("doc_id", "text"), size=5, least=80)
    gone = written(linked.where("doc_id != component_id").select("doc_id").distinct(), "gone")  # so that its size is known
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat an earlier one; drop documents of which nothing but blanks is left.

    Null and short texts stay as they are; of rows with one long text the first stays; texts of any length are cut whole;
    other columns stay as they are, also those named like a result.
    """
    return suffix_dedup.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage, all rows that share a doc_id, and without one each by its text.

    Null texts stay; without benchmark items all stay; texts of any length are read whole; other columns stay as they are,
    also those named like a result.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.contaminated_rows(docs, benchmark)
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("hit_text")).distinct()
    hit = written(hit, "hits")  # so that its size is known
    text_of = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"]))
    same = docs["doc_id"].eqNullSafe(hit["hit_id"]) & text_of.eqNullSafe(hit["hit_text"])
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left: piece ids, and the hash of the decoded text.

    Null and empty texts have one empty segmentation; equal texts of different rows are sampled by their own doc_id; texts
    of any length are encoded whole; other columns are left out, so none can clash.
    """
    return pieces.encoded_rows(docs, pieces.load_pieces())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]
#: No stage but the exact ones can be told in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
