"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kwhrecon.llm import bpe, common, langid, minhash, mixing, substrings

#: The mix's target weights, its least size against its input, and the least rate: every document stays at least once.
TARGETS, GROWTH, LEAST = {"clean": 0.8, "low": 0.1, "toxic": 0.1}, 1.25, 1.0


def language_id(spark, docs, sf_dir):
    """Drops documents without a language (no text, no letters) or with none that prevails.

    Null and empty texts go, null ids stay if their text has a language; a very
    long text is judged whole. Equal shares go to the first language in the
    alphabet; repeated rows are judged alike. Where nothing teaches, every text
    with letters stays. An empty table stays empty; columns of any name pass through.
    """
    return langid.accepted(docs, langid.learn(langid.learning_rows(docs)))


def near_dedup(spark, docs, sf_dir):
    """Keeps the least document of each group of near copies.

    Rows are told apart by (doc_id, text): texts that differ under one id, and
    rows with a null id, are documents of their own and stay unless they are
    near copies of another. They come after all others in the order of ids. Of
    rows with the same id and text one stays. Documents without words stay. An
    empty table stays empty; columns of any name pass through.
    """
    return minhash.first_of_copies(docs)


def substring_dedup(spark, docs, sf_dir):
    """Cuts out repeated passages; a document that consists of them alone goes.

    A null text has no passage and stays as it is, like an empty one; of a very
    long text every window counts. Equal passages stay in the document with the
    smallest id; rows that repeat an id, or have none, never cut each other.
    An empty table stays empty; columns of any name pass through.
    """
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark, docs, sf_dir):
    """Repeats documents by the rates that bring the labelled domains to their target weights.

    No document goes. Null and empty texts have no tokens and keep the rate 1 or
    the rate of their posterior; whole long texts are scored. Ties of the fit do
    not matter, as the rates are numbers; a row's last fraction is drawn by a hash
    of its id (of its text without one), so repeated rows are repeated alike.
    Without labels, or without rows, nothing changes; columns of any name pass through.
    """
    labels = mixing.domains(common.read(spark, sf_dir, "labels"))
    _, model, residuals = mixing.mix(docs, labels, TARGETS, LEAST, GROWTH)
    return mixing.mixed(docs, model, residuals, LEAST)


def bpe_round_trip(spark, docs, sf_dir):
    """Tokens of what is left, and the digest of its decoded text.

    One row per row, repeated ones included; a null text is an empty one, a null
    id stays null; long texts are encoded whole; other columns are left out; an
    empty table gives no rows. There are no ties.
    """
    return bpe.encode_decode(docs, bpe.default_path())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("soft_mixing", mix),
    ("bpe_round_trip", bpe_round_trip),
]

#: SQL can't express the language model or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply the stages to ``documents``; each stage's result is stored in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
