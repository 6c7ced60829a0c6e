"""Corpus pipeline: language id, exact dedup, near dedup, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.stored import remove
from rubrica.llm import decontaminate, exact_dedup, langid, packing, simhash_dedup
from rubrica.llm.shared import checkpoint_folder, cut_lineage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not those without letters, nor letter noise.

    The model learns from the given documents, with noise as one more class; how likely noise must be is set
    by labelled texts.  A text goes only if its neighbouring letters also are as independent as shuffled
    ones, which those of no language are, labelled or not.  Where nothing can be learned, all with letters stay.
    """
    label, score = free_names(docs, "language", "likelihood")
    model = langid.fit_rejecting(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    identified = langid.identify(docs, model, label, score)
    kept = identified.filter(F.col(label) != langid.UNKNOWN)
    return kept.select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    Rows that repeat both id and text become one.
    """
    groups = exact_dedup.exact_groups(docs, keep="largest")
    out = keep_rows(docs, groups.filter("kept").select("doc_id", "text_sha256"))
    twins = groups.filter("doc_id <=> keep_id").groupBy("text_sha256").count().filter("count > 1")
    twins = cut_lineage(twins.select("text_sha256"))
    if not twins.take(1):
        return out
    (name,) = free_names(docs, "digest")
    marked = out.withColumn(name, digest())
    repeated = marked.join(twins, marked[name] == twins["text_sha256"], "left_semi").dropDuplicates([name])
    single = marked.join(twins, marked[name] == twins["text_sha256"], "left_anti")
    return single.unionByName(repeated).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash (four-word shingles, at most four bits
    apart): the one with the smallest id."""
    groups = simhash_dedup.near_groups(docs)
    return keep_rows(docs, groups.filter("kept").select("doc_id", F.lower(F.hex("digest")).alias("text_sha256")))


def digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose id (null too) and text are among ``kept`` (doc_id, text_sha256)."""
    (name,) = free_names(docs, "digest")
    marked = docs.withColumn(name, digest())
    same = marked["doc_id"].eqNullSafe(kept["doc_id"]) & (marked[name] == kept["text_sha256"])
    return marked.join(kept, same, "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    (mark,) = free_names(docs, "contaminated")
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), mark=mark)
    return marked.filter(~F.col(mark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language id", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL cannot express the language model, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written to the shared folder and read again, and its input,
    if that is a stage's output, removed."""
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
