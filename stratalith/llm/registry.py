"""Query names of this subpackage, as thin callables over (spark, sf_dir)."""

from __future__ import annotations

import secrets
from functools import lru_cache

from stratalith.llm.common import table
from stratalith.llm.oracles import ORACLE_SQL  # noqa: F401


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _session_key() -> str:
    return secrets.token_hex(16)


def pseudonym_key(spark) -> str:
    """The configured key; without one a random key, under which values are linked within this application only."""
    return spark.conf.get("spark.stratalith.pseudonymKey", None) or _session_key()


def op1_scaled_fingerprint(spark, sf_dir):
    from stratalith.llm.fingerprint import fingerprints_with_neighbour

    return fingerprints_with_neighbour(table(spark, sf_dir, "documents"))


def op2_nn_descent_dedup(spark, sf_dir):
    from stratalith.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_count(spark, sf_dir):
    from stratalith.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op4_differencing_pack(spark, sf_dir):
    from stratalith.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024)


def op5_fuzzy_line_dedup(spark, sf_dir):
    from stratalith.llm.line_dedup import deduplicated_lines

    return deduplicated_lines(table(spark, sf_dir, "documents"))


def op6_pu_toxicity(spark, sf_dir):
    from stratalith.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark, sf_dir):
    from stratalith.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=20, with_text=False)


def op8_temperature_mix(spark, sf_dir):
    from pyspark.sql import functions as F

    from stratalith.llm.mixing import mixture
    from stratalith.llm.packing import n_tokens

    return mixture(table(spark, sf_dir, "documents"), tokens=n_tokens(tokenizer_path(), F.col("text"))).drop("text", "lang", "n_chars")


def op9_feistel_pseudonyms(spark, sf_dir):
    from stratalith.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key=pseudonym_key(spark))


def op10_minmax_near_dedup(spark, sf_dir):
    from stratalith.llm.minmax_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_scaled_fingerprint,
        op2_nn_descent_dedup,
        op3_token_count,
        op4_differencing_pack,
        op5_fuzzy_line_dedup,
        op6_pu_toxicity,
        op7_substring_dedup,
        op8_temperature_mix,
        op9_feistel_pseudonyms,
        op10_minmax_near_dedup,
    )
}
