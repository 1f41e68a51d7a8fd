"""The corpus operators' queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fogbank.llm import decontam, extract, fingerprint, infill, langid, minhash, mixing, secrets, sharding, spelling, substring, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_substring": substring.op2_substring,
        "op3_language_id": langid.op3_language_id,
        "op4_sharding": sharding.op4_sharding,
        "op5_warc_revisits": warc.op5_warc_revisits,
        "op6_fingerprints": fingerprint.op6_fingerprints,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_mixing": mixing.op8_mixing,
        "op9_secrets": secrets.op9_secrets,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_infill": infill.op11_infill,
        "op12_spelling": spelling.op12_spelling,
        "op13_extraction": extract.op13_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": minhash.OP1_SQL,
        "op2_substring": substring.OP2_SQL,
        "op4_sharding": sharding.OP4_SQL,
        "op5_warc_revisits": warc.OP5_SQL,
        "op7_decontamination": decontam.OP7_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op9_secrets": secrets.OP9_SQL,
        "op11_infill": infill.OP11_SQL,
        "op12_spelling": spelling.OP12_SQL,
        "op13_extraction": extract.OP13_SQL,
    }
