"""A corpus from raw documents to token ids, stage by stage.

Every stage takes (spark, docs, sf_dir); all but the last return documents
(doc_id, text, lang, source, n_chars). run() gives one row per document kept:
doc_id, n_ids, ids, round_trip.
"""

from __future__ import annotations

from quadrille.llm import decontamination, jaccard_join, language_id, piece_tokens, pii
from quadrille.llm.workspace import durable


def language_id_stage(spark, docs, sf_dir):
    """Documents without a language go: null, empty or letterless text, letters that the network's class for made-up text
    gets more of than of held-out documents, and scripts of no learned language. Where no row is labelled, no language is
    learned, and only documents without a letter go.

    The labels in lang stay as given. Repeated rows and null ids are judged by their text like others; an empty table stays empty.
    """
    return language_id.keep_learned(docs)


def ngram_jaccard_stage(spark, docs, sf_dir):
    """Of documents linked by five-word n-grams at a similarity of 0.8 or more, the one with the smallest id stays.

    Null ids and texts without words are linked with nothing and stay; of rows that repeat an id one stays: the first by a
    hash of its text, then by all its columns, whatever the partitioning.
    """
    return jaccard_join.keep_one_of_each_group(docs, k=5, num=80, den=100)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold four fifths of a benchmark item's words, in matches of five or more, go.

    Null and empty texts are clean, and so is all without a benchmark; items without id, text or words match nothing, and
    items of fewer than five words where these stand in one run.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark, docs, sf_dir):
    """Personal data is masked in the text, and n_chars follows; null stays null, and every row stays."""
    return pii.mask_personal_data(docs)


def sentencepiece_stage(spark, docs, sf_dir):
    """Texts become token ids; null text gives null ids, empty text none; every row stays."""
    return piece_tokens.encode_documents(docs)


STAGES = [
    ("language_id", language_id_stage),
    ("ngram_jaccard_join", ngram_jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Training, tiling and Viterbi paths have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


#: What these give is read several times by the stages after them: run() writes it, so that nothing is computed twice.
CUT = ("language_id", "ngram_jaccard_join")


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = durable(docs) if name in CUT else docs
    return docs
