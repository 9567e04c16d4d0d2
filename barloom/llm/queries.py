"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from barloom.llm import audit, bpe, contamination, licenses, lines, merkle, quality, simhash, tokens, topk, toxicity, urls, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_token_files": tokens.op3_token_files,
    "op4_url_filter": urls.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_benchmark_leaks": contamination.op9_benchmark_leaks,
    "op10_warc": warc.op10_warc,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_quality": quality.op12_quality,
    "op13_filter_audit": audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_exact_top_k": topk.OP2_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
