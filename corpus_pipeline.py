"""From raw documents to token ids: toxic documents go, repeated runs of lines go, near-duplicates go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and gives documents with the same columns, but for the last one, which gives token counts
and digests. What a stage decides holds for all later ones. The classifier judges each row by its own text, also where rows share a
doc_id; of near-duplicates, rows that share a doc_id stay or go together. Rows with a null doc_id are no near-duplicates of others,
and for the lines the parts of one document that comes last. Null texts have no words, no lines to remove and no ids; long ones are
taken whole. Rows that repeat are rows like others. Extra columns pass all stages but the last, whatever their names. Without
documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bpe, lines, minhash, mixing, shared, toxicity


def _named(docs: DataFrame) -> list:
    """docs' columns, which may have any name."""
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it is fitted on the labels outside fold 0."""
    return toxicity.clean(docs, toxicity.train(docs, shared.read(spark, sf_dir, "labels")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that came before; n_chars is counted anew where text changed."""
    out = lines.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*_named(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity of 0.8 or more, over any number of links) the one with the smallest doc_id."""
    gone = minhash.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*_named(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more often, as its source's weight asks for."""
    return mixing.realised(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each passed document, counted and digested, and the digest of what they decode to."""
    return bpe.production(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, last = shared.written(), docs
        docs = shared.table(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.drop_since(mark, docs)  # what the stage wrote on its way
        if name != STAGES[0][0]:
            shared.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
