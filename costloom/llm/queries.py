"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from costloom.llm import audit, bbit, exact_dedup, html, jaccard, merkle, mixing, packing, pii, quality, secrets, tiff, warc

QUERIES = {
    "op1_tiff": tiff.op1_tiff,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_packing": packing.op3_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_secrets": secrets.op7_secrets,
    "op8_html": html.op8_html,
    "op9_warc": warc.op9_warc,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_bbit_minhash": bbit.op13_bbit_minhash,
}
ORACLES = {
    "op7_secrets": secrets.ORACLE,
    "op9_warc": warc.ORACLE,
    "op2_jaccard": jaccard.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_bbit_minhash": bbit.ORACLE,
}
