"""The corpus pipeline: good documents, without common lines, near copies or benchmark passages, packed.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all that its
predecessor kept.  All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.llm import decontamination, line_dedup, packing, quality, simhash
from ferryline.llm.common import shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_stage(spark, docs, sf_dir):
    """Lines found in ten documents or more go; n_chars is counted anew."""
    out = line_dedup.without_common_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return simhash.near_dedup(docs).select(*COLUMNS)


def benchmark_stage(spark, docs, sf_dir):
    """Documents that the contamination rule finds go."""
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark, docs, sf_dir):
    """The rest is packed: a row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifier, XXH64 or the tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := shared_path(spark, "stage"))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
