"""The registered queries of the corpus operators."""

from __future__ import annotations

from . import decontaminate, hard_negatives, html_text, language_id, periodic_runs, poisson_mix, quality, simhash, suffix_dedup, token_files, toxicity, warc, weighted_sampling


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": _pipeline,
        "op1_weighted_sampling": weighted_sampling.op1,
        "op2_toxicity": toxicity.op2,
        "op3_token_files": token_files.op3,
        "op4_quality": quality.op4,
        "op5_decontaminate": decontaminate.op5,
        "op6_poisson_mix": poisson_mix.op6,
        "op7_html_text": html_text.op7,
        "op8_language_id": language_id.op8,
        "op9_suffix_dedup": suffix_dedup.op9,
        "op10_simhash_near_dedup": simhash.op10,
        "op11_periodic_runs": periodic_runs.op11,
        "op12_warc": warc.op12,
        "op13_hard_negatives": hard_negatives.op13,
    }


def oracle_sql():
    return {"op6_poisson_mix": poisson_mix.OP6_SQL, "op12_warc": warc.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
