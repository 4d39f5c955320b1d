"""The training-data queries, by name, and their SQL counterparts."""

from __future__ import annotations

from marlstone.llm import importance, prefix_trie, quality_rules, vectors
from marlstone.llm.audio import op1_chroma_fingerprints
from marlstone.llm.classifier import op9_quality_classifier
from marlstone.llm.html import op6_html_extraction
from marlstone.llm.mixing import op10_mixing
from marlstone.llm.near_dups import op8_minhash_near_dedup
from marlstone.llm.packing import op3_best_fit_packing
from marlstone.llm.pii import op2_pii_surrogates
from marlstone.llm.repeats import op5_suffix_dedup
from marlstone.llm.token_counts import op4_token_counts


def queries() -> dict:
    return {
        "op1_chroma_fingerprints": op1_chroma_fingerprints,
        "op2_pii_surrogates": op2_pii_surrogates,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_token_counts": op4_token_counts,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_mixing": op10_mixing,
        "op11_near_vectors": vectors.op11_near_vectors,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_importance_resampling": importance.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.SQL, "op11_near_vectors": vectors.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_importance_resampling": importance.SQL}
