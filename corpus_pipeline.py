"""A cleaning and packing pipeline over ``documents``, of five stages of the training-data operators.

1. ``quality``: documents that the quality classifier rejects go.
2. ``line_dedup``: boilerplate lines that many sources share are cut from texts.
3. ``near_duplicates``: of each group of near copies (five-word shingles, similarity of 0.8 or
   more) the document with the least doc_id stays.
4. ``pii``: personal data become format-preserving pseudonyms.
5. ``pack``: the documents are packed into sequences of 4096 tokens.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.

Defined results: a null text is scored as an empty one, has no lines and no near copies, stays null and is packed
as the separator alone; a document of which nothing is left after ``line_dedup`` goes on as an empty one; rows
without a doc_id stay; of rows with one doc_id in a group of copies one stays; ``n_chars`` follows the text; extra columns pass
through up to the last stage; texts of any length are whole; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import jaccard, line_dedup, packing, pii, quality
from weftline.llm.common import dropped, staged
from weftline.llm.queries import GOOD, MIN_SITES, PII_KEY, TOKENIZER, held_out, tokenizer_path
from weftline.session import table

WORDS, SIMILARITY = 5, "0.8"


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``columns``, with the number of characters as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score ``GOOD`` or more; the model is fitted on labelled rows that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    stats = staged(quality.document_statistics(docs), "quality-stats")
    model = quality.QualityModel.fit(quality.labelled_rows(stats, labels))
    dropped(stats)
    return quality.keep_good(docs, model, GOOD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over ``MIN_SITES`` sources."""
    return _as_documents(line_dedup.remove_boilerplate(docs, min_sites=MIN_SITES), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id."""
    return jaccard.keep_one(docs, WORDS, SIMILARITY)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return _as_documents(pii.pseudonymise(docs, PII_KEY), docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    return packing.pack(packing.pieces(docs, tokenizer_path(TOKENIZER)), docs.count())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("pack", pack_stage),
]

#: The classifier and the packer have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
