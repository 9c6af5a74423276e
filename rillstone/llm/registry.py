"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, line_dedup, order_minhash, packing, quality, secrets, simhash, token_counts, tokenization, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_harmonic_packing": packing.op1_harmonic_packing,
        "op2_chat_transcripts": chat.op2_chat_transcripts,
        "op3_warc_derivatives": warc.op3_warc_derivatives,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_order_minhash": order_minhash.op5_order_minhash,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_simhash_near_duplicates": simhash.op8_simhash_near_duplicates,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_bpe_codec": tokenization.op10_bpe_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.OP4_SQL}
