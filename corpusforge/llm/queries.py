"""Queries of the corpus operators and their SQL, added by the entry file when this subpackage is there."""

import corpus_pipeline
from corpusforge.llm import (decontamination, embedding_dedup, html_text, lm_scoring, mixing, near_dedup,
                             prefix_trie, quality, substring_dedup, suffix_dedup, token_alignment, token_files, toxicity)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_files": token_files.op3_token_files,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_quality": quality.op13_quality,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
