"""The queries of this package, and the SQL counterparts of those that SQL can express.

Tokenizers, learned rules and models, packings and fingerprints are not SQL; ``tests/llm`` checks them against brute force.
"""

from __future__ import annotations

from hashmark.llm.bpe import op4_bpe
from hashmark.llm.fingerprint import op10_fingerprints
from hashmark.llm.langid import op3_language_id
from hashmark.llm.lines import op5_line_dedup
from hashmark.llm.lmscore import op9_lm_scoring
from hashmark.llm.minhash import op1_minhash
from hashmark.llm.neighbours import op12_nearest
from hashmark.llm.oracles import ORACLES  # noqa: F401
from hashmark.llm.packing import op7_packing
from hashmark.llm.quality import op2_quality_rules
from hashmark.llm.repair import op13_conversation_repair
from hashmark.llm.suffix import op6_suffix_dedup
from hashmark.llm.toxicity import op8_toxicity
from hashmark.llm.trie import op11_prefix_trie

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_fingerprints": op10_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_nearest": op12_nearest,
    "op13_conversation_repair": op13_conversation_repair,
}
