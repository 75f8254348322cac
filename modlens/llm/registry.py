"""Named queries of the training-data operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from modlens.llm import (
    exact_dedup, language, lexical, packing, pieces, quality, quality_model, repeats, resampling, signature_join,
    token_files, toxicity, url_rules,
)
from modlens.registry.inputs import Query

QUERIES = {
    "op1_signature_join": Query(signature_join.op1),
    "op2_token_files": Query(token_files.op2),
    "op3_packing": Query(packing.op3),
    "op4_merge_dropout": Query(pieces.op4),
    "op5_toxicity": Query(toxicity.op5),
    "op6_repeats": Query(repeats.op6),
    "op7_exact_dedup": Query(exact_dedup.op7, exact_dedup.SQL),
    "op8_language": Query(language.op8),
    "op9_url_rules": Query(url_rules.op9, url_rules.SQL),
    "op10_quality_rules": Query(quality.op10, quality.SQL),
    "op11_quality_model": Query(quality_model.op11),
    "op12_lexical_search": Query(lexical.op12, lexical.SQL),
    "op13_resampling": Query(resampling.op13, resampling.SQL),
}
