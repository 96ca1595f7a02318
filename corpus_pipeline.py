"""From ``documents`` to token ids: five stages, each over all that the one before kept.

1. ``toxicity``: documents that the compression model, fitted on labelled rows, finds toxic go.
2. ``near_duplicates``: of each group of SimHash near-copies the document with the smallest id stays.
3. ``personal_data``: spans of personal data are replaced by their kind in brackets.
4. ``mixing``: documents repeat, or go, so that sources come near their target weights.
5. ``tokens``: texts become ids of the byte-level BPE vocabulary, and are checked by decoding them again.

Nulls, empty texts and repeated rows are treated as the operators' docstrings say; all
stages but the last return the columns of ``documents`` and pass an empty table on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, pii, simhash, toxicity
from tidemark.llm.common import free, rewritten, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free("__score", docs)
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but for the text, n_tokens, ids, and whether these decode to the text's bytes."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    ids, decoded = free("__ids", docs), free("__bytes", docs)
    both = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN, ids=ids, decoded=decoded)
    same = F.col(decoded) == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]
    return both.select(*rest, bpe.n_tokens(ids).alias("n_tokens"), F.col(ids).alias("ids"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: SQL can train no compression model and draw no BPE merges; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = rewritten(docs)
    return docs
