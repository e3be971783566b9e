"""Queries and their DuckDB counterparts, by name."""

from __future__ import annotations

import public_tokenizers

from . import exact_dedup, jaccard_join, line_dedup, media, packing, passages, pii, quality, sampled_pieces
from .common import documents
from .token_counts import token_counts


def op1_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_media(spark, sf_dir):
    return media.media_digest(documents(spark, sf_dir))


def op7_sampled_pieces(spark, sf_dir):
    return sampled_pieces.sample_digest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_passages": passages.op3_passages,
    "op4_media": op4_media,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality": quality.op6_quality,
    "op7_sampled_pieces": op7_sampled_pieces,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_pii": pii.op9_pii,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
