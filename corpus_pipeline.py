"""The corpus pipeline: raw documents to a mixed, tokenised corpus, in five stages.

Every stage takes all that its predecessor kept. The first four return the columns of documents
(n_chars follows the text); the last one returns the token ids of each copy the mix takes,
and the text they decode to. Null, empty, repeated and very long rows are handled as each operator's
module states; ties are broken there, too. A document that loses all its words to the substring stage stays, empty, and
the mix takes it no times. Extra columns pass through the first four stages whatever their names, those of the
operators' own columns included. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faturaflow.llm import bpe, jaccard_join, language, mixing, substring_dedup
from faturaflow.llm.common import table, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., which no operator's own columns are named like; and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, those with no letter at all, go; a null lang becomes the language that is found."""
    texts = language.sample(docs.filter(~language.held_out(5)))
    rows, new = _numbered(docs)
    found = language.predict(rows, texts, new["text"]).filter("lang_pred <> 'und'")
    lang = F.coalesce(new["lang"], "lang_pred")
    return found.select(*[(lang if c == "lang" else F.col(n)).alias(c) for c, n in new.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar ones stays, whatever ids repeat or are null."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that are found elsewhere go."""
    rows, new = _numbered(docs)
    kept = substring_dedup.dedup(rows, text=new["text"], ident=new["doc_id"])
    size = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[(size if c == "n_chars" else F.col(n)).alias(c) for c, n in new.items()])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, text): ids are little-endian unsigned 32-bit integers, text is decoded from them."""
    import public_tokenizers

    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixed_sources),
    ("bpe", tokens),
]

#: Automata and merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
