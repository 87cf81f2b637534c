"""The registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .chat import OP2_SQL, op2_chat_format
from .dedup import OP7_SQL, op7_exact_dedup
from .langid import op5_language_id
from .ngram_join import op1_ngram_jaccard
from .packing import op4_best_fit_packing
from .pii import op6_pii_pseudonyms
from .quality import OP10_SQL, op10_quality_rules
from .substring import OP9_SQL, op9_substring_dedup
from .token_files import op3_token_files


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_chat_format": op2_chat_format,
        "op3_token_files": op3_token_files,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_language_id": op5_language_id,
        "op6_pii_pseudonyms": op6_pii_pseudonyms,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_rules": op10_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL}
