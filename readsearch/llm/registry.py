"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact, langid, license, mixing, quality, simhash, substring, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_quality": quality.op2_quality,
        "op3_exact": exact.op3_exact,
        "op4_substring": substring.op4_substring,
        "op5_bpe": bpe.op5_bpe,
        "op6_langid": langid.op6_langid,
        "op7_mixing": mixing.op7_mixing,
        "op8_license": license.op8_license,
        "op9_warc": warc.op9_warc,
        "op10_chat": chat.op10_chat,
        "quality_ablations": quality.quality_ablations,
    }


def oracle_sql() -> dict[str, str]:
    """op1, op5 and op6 have no SQL: the tests hold them against brute force."""
    return {
        "op2_quality": quality.OP2_SQL,
        "op3_exact": exact.OP3_SQL,
        "op4_substring": substring.OP4_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op8_license": license.OP8_SQL,
        "op9_warc": warc.OP9_SQL,
        "op10_chat": chat.OP10_SQL,
        "quality_ablations": quality.ABLATIONS_SQL,
    }
