"""Registered queries of the corpus operators, and SQL for those it can express."""

from __future__ import annotations

from veridict.llm import oracles
from veridict.llm.byte_bpe import op3_byte_bpe
from veridict.llm.chat import op6_chat_format
from veridict.llm.decontamination import op10_decontamination
from veridict.llm.exact_dedup import op11_exact_dedup
from veridict.llm.line_dedup import op1_line_dedup
from veridict.llm.lm_scoring import op7_lm_scoring
from veridict.llm.ngram_join import op2_ngram_jaccard
from veridict.llm.passages import op4_substring_dedup
from veridict.llm.phrases import op13_phrase_collocations
from veridict.llm.quality import op8_quality_rules
from veridict.llm.sharding import op5_sharding
from veridict.llm.toxicity import op9_toxicity
from veridict.llm.whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_ngram_jaccard, op3_byte_bpe, op4_substring_dedup, op5_sharding, op6_chat_format, op7_lm_scoring,
        op8_quality_rules, op9_toxicity, op10_decontamination, op11_exact_dedup, op12_embedding_whitening, op13_phrase_collocations,
    )
}
#: No SQL for the others: a trained tokenizer's merges, windows of min-hashes, a dynamic program over turns,
#: a kernel machine, spaced seeds and eigenvectors are tested against brute force, exact round trips and held-out accuracy.
ORACLES: dict[str, str] = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op2_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op5_sharding": oracles.SHARDING,
    "op7_lm_scoring": oracles.LM_SCORING,
    "op8_quality_rules": oracles.quality_rules(),
    "op11_exact_dedup": oracles.EXACT_DEDUP,
    "op13_phrase_collocations": oracles.PHRASES,
}
