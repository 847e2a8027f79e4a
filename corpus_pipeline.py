"""A corpus from raw documents to packed sequences, in five stages, each one operator of ``meridian.llm``.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import fuzzy_simhash, language_id, mixing, packing, suffix_dedup
from meridian.llm.common import scratch

#: Some stages are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def _others(docs: DataFrame, *without: str):
    """All columns but some as one struct, so that no name can clash with an operator's."""
    names = [c for c in docs.columns if c not in without]
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("__none"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or a letter in it go, and those whose nearest two codewords are too alike to choose from.

    These are texts of a word or so (4 in 10,000 here); all others stay as they are, whatever their language. Learns from
    the labelled documents that are not held out; without any nothing is learned, and documents with a letter stay.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    if not model.langs:
        return docs.where(F.udf(lambda t: bool(t and language_id.LETTER.search(t)), "boolean")("text"))
    rows = docs.select("doc_id", "text", _others(docs, "text").alias("__row"))
    seen = language_id.identify(rows, model, keep=("__row",), keep_text=True).where("lang_pred <> 'und' and not ambiguous")
    return seen.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the smallest doc_id."""
    return fuzzy_simhash.keep_one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (51 words of 200 bytes or more) that other documents hold too are cut from the texts.

    Every copy goes; documents stay, n_chars follows. What repeats only inside a document stays.
    """
    done = suffix_dedup.repeated_bytes(docs, suffix_dedup.PASSAGES, kept=0, carry=_others(docs, "text"))
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[(new[c] if c in new else F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 4096 tokens as can be."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch(docs, f"stage{n}")
    return docs
