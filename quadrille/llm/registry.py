"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quadrille.llm import bpe, fingerprints, html_text, jaccard_join, language_id, licenses, packing, quality, toxicity, warc

QUERIES: dict = {
    "op1_warc": warc.query,
    "op2_best_fit_packing": packing.query,
    "op3_quality_rules": quality.query,
    "op4_license_scans": licenses.query,
    "op5_ngram_jaccard_join": jaccard_join.query,
    "op6_byte_level_bpe": bpe.query,
    "op7_language_id": language_id.query,
    "op8_html_extraction": html_text.query,
    "op9_document_fingerprints": fingerprints.query,
    "op10_toxicity": toxicity.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict = {
    "op1_warc": warc.ORACLE_SQL,
    "op5_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
}
