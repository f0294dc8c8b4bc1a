"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from factlake.llm import pipeline, sql
from factlake.llm.alignment import op13_token_alignment
from factlake.llm.bpe import op1_byte_bpe
from factlake.llm.conversations import op11_conversation_repair
from factlake.llm.decontaminate import op7_decontaminate
from factlake.llm.embedding import op6_embedding_dedup
from factlake.llm.html_text import op2_html_text
from factlake.llm.jaccard import op9_ngram_jaccard
from factlake.llm.license import op4_license
from factlake.llm.lm_score import op8_lm_score
from factlake.llm.pii import op3_pii
from factlake.llm.quality import op10_quality
from factlake.llm.substring import op5_substring_dedup
from factlake.llm.url_filter import op12_url_filter

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_text": op2_html_text,
    "op3_pii": op3_pii,
    "op4_license": op4_license,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_url_filter": op12_url_filter,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline.run,
}

ORACLES = {"op5_substring_dedup": sql.SUBSTRING, "op7_decontaminate": sql.DECONTAMINATE, "op11_conversation_repair": sql.CONVERSATIONS}
