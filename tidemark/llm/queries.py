"""Queries of this subpackage, and SQL where it can say the same."""

from tidemark.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from tidemark.llm.decontamination import OP8_SQL, op8_decontamination
from tidemark.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from tidemark.llm.html_extraction import op7_html_extraction
from tidemark.llm.lm_scoring import op9_lm_scoring
from tidemark.llm.merkle import OP11_SQL, op11_merkle_manifest
from tidemark.llm.near_dedup import OP4_SQL, op4_near_dedup
from tidemark.llm.quality import op6_quality
from tidemark.llm.secrets import op5_secrets
from tidemark.llm.sentence_pieces import op1_sentence_pieces
from tidemark.llm.substring_dedup import OP13_SQL, op13_substring_dedup
from tidemark.llm.token_output import op2_token_output
from tidemark.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_token_output": op2_token_output,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL = {
    "op4_near_dedup": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_substring_dedup": OP13_SQL,
}
