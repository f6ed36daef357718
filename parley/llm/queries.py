"""Queries of this subpackage over the test tables, and their checking SQL."""
import corpus_pipeline
from parley.llm import bpe, ctw, fingerprints, linededup, mixing, neardup, quality, ranked, rules, secretscan, spelling, surrogates, tokenfiles


def queries():
    return {
        "op1_quality_score": quality.query,
        "op2_quality_rules": rules.query,
        "op3_pii_surrogates": surrogates.query,
        "op4_line_dedup": linededup.query,
        "op5_near_dedup": neardup.query,
        "op6_lm_score": ctw.query,
        "op7_byte_bpe": bpe.query,
        "op8_secret_scan": secretscan.query,
        "op9_source_mix": mixing.query,
        "op10_fingerprints": fingerprints.query,
        "op11_ranked_search": ranked.query,
        "op12_token_files": tokenfiles.query,
        "op13_spelling_variants": spelling.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_quality_rules": rules.SQL,
        "op4_line_dedup": linededup.SQL,
        "op5_near_dedup": neardup.SQL,
        "op11_ranked_search": ranked.SQL,
        "op13_spelling_variants": spelling.SQL,
    }
