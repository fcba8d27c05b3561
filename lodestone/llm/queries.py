"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP13_SQL, op13_phrase_collocations
from .decontamination import op4_benchmark_decontamination
from .embeddings import op2_embedding_near_dedup
from .jaccard import op6_ngram_jaccard_join
from .language import op9_language_id
from .lines import OP8_SQL, op8_line_dedup, op8_line_run_dedup
from .packing import op10_best_fit_packing
from .parsing import op12_suffix_array_dedup
from .scoring import op3_lm_scoring
from .substrings import op5_substring_dedup
from .tokens import op1_token_counts
from .toxicity import op7_toxicity
from .variants import op11_spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_embedding_near_dedup,
        op3_lm_scoring,
        op4_benchmark_decontamination,
        op5_substring_dedup,
        op6_ngram_jaccard_join,
        op7_toxicity,
        op8_line_dedup,
        op8_line_run_dedup,
        op9_language_id,
        op10_best_fit_packing,
        op11_spelling_variants,
        op12_suffix_array_dedup,
        op13_phrase_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op13_phrase_collocations": OP13_SQL}
