"""The numbered queries, the pipeline, and their SQL."""

from __future__ import annotations

from . import bpe, collocations, fingerprints, html_extract, jaccard_join, language_id, licenses, mixing, quality, secret_scan, substring_dedup, url_filter, vector_codes


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_licenses": licenses.op2_licenses,
        "op3_html": html_extract.op3_html,
        "op4_secrets": secret_scan.op4_secrets,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_urls": url_filter.op6_urls,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_bpe": bpe.op8_bpe,
        "op9_quality": quality.op9_quality,
        "op10_mixing": mixing.op10_mixing,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_language_id": language_id.op12_language_id,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.op2_sql(), "op6_urls": url_filter.op6_sql(), "op11_vector_codes": vector_codes.op11_sql(), "op13_collocations": collocations.op13_sql()}
