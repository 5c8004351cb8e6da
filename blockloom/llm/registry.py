"""The corpus operators' queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, jaccard, language, mixing, ppm, quality, secrets, simhash, token_counts, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_mix": mixing.op2,
    "op3_ppm": ppm.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_simhash": simhash.op5,
    "op6_token_counts": token_counts.op6,
    "op7_secrets": secrets.op7,
    "op8_jaccard": jaccard.op8,
    "op9_quality": quality.op9,
    "op10_language": language.op10,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
