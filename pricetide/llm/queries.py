"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_store, exact_dedup, language_net, mixing, order_minhash, packing, phrase_fingerprint, sanitise, secret_links, trie_counts
from .common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": lambda s, d: mixing.mix(documents(s, d)),
        "op2_sanitise": lambda s, d: sanitise.scan(documents(s, d)),
        "op3_phrases": lambda s, d: phrase_fingerprint.fingerprint_rows(documents(s, d)),
        "op4_trie_counts": lambda s, d: trie_counts.token_counts(documents(s, d), _vocabulary("piece_bpe_32k.model")),
        "op5_order_minhash": lambda s, d: order_minhash.near_duplicates(documents(s, d)),
        "op6_packing": lambda s, d: packing.pack(documents(s, d), _vocabulary("byte_bpe_50k.json")),
        "op7_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(documents(s, d)),
        "op8_chunk_store": lambda s, d: chunk_store.stored(documents(s, d), _vocabulary("word_bpe_49k.json")),
        "op9_language": lambda s, d: language_net.identify(documents(s, d)),
        "op10_secrets": lambda s, d: secret_links.scan(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.oracle(), "op7_exact_dedup": exact_dedup.ORACLE}
