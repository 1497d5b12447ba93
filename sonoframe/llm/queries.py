"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from sonoframe.llm.chat_format import op7_chat_format
from sonoframe.llm.decontaminate import OP2_SQL, op2_decontaminate
from sonoframe.llm.lm_scoring import OP1_SQL, op1_lm_scoring
from sonoframe.llm.ngram_join import op9_ngram_join
from sonoframe.llm.oracles import OP3, OP7, OP9, quality, urls
from sonoframe.llm.packing import op4_packing
from sonoframe.llm.quality import op5_quality
from sonoframe.llm.suffix_dedup import op3_suffix_dedup
from sonoframe.llm.token_counts import op10_token_counts
from sonoframe.llm.toxicity import op8_toxicity
from sonoframe.llm.url_filter import op6_url_filter

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_suffix_dedup": OP3,
    "op5_quality": quality(),
    "op6_url_filter": urls(),
    "op7_chat_format": OP7,
    "op9_ngram_join": OP9,
}
