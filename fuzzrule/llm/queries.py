"""The training-data queries and, where SQL can express them, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fuzzrule.llm import oracle
from fuzzrule.llm.binary_search import op3_exact_topk
from fuzzrule.llm.decontaminate import op10_latent_decontamination
from fuzzrule.llm.hard_negatives import op11_hard_negatives
from fuzzrule.llm.line_dedup import op2_line_dedup
from fuzzrule.llm.mixing import op6_source_mixing
from fuzzrule.llm.ngram_join import op7_ngram_jaccard_join
from fuzzrule.llm.packing import op8_token_packing
from fuzzrule.llm.quality import op4_attention_quality
from fuzzrule.llm.secrets import op5_secret_forest
from fuzzrule.llm.sharding import op9_jump_sharding
from fuzzrule.llm.spelling import op13_spelling_permuterm
from fuzzrule.llm.toxicity import op12_toxicity_kneser_ney
from fuzzrule.llm.warc import op1_warc_archive


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_warc_archive, op2_line_dedup, op3_exact_topk, op4_attention_quality, op5_secret_forest, op6_source_mixing,
           op7_ngram_jaccard_join, op8_token_packing, op9_jump_sharding, op10_latent_decontamination,
           op11_hard_negatives, op12_toxicity_kneser_ney, op13_spelling_permuterm)
    return {**{f.__name__: f for f in ops}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_archive": oracle.WARC_ARCHIVE, "op2_line_dedup": oracle.LINE_DEDUP, "op3_exact_topk": oracle.EXACT_TOPK,
            "op6_source_mixing": oracle.SOURCE_MIXING,
            "op9_jump_sharding": oracle.JUMP_SHARDING, "op11_hard_negatives": oracle.HARD_NEGATIVES,
            "op13_spelling_permuterm": oracle.SPELLING_FORMS}
