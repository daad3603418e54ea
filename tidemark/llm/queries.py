"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidemark.llm.byte_bpe import op3_byte_bpe
from tidemark.llm.decontaminate import op8_decontamination
from tidemark.llm.interactions import OP12_SQL, op12_filter_interactions
from tidemark.llm.licenses import OP2_SQL, op2_licenses
from tidemark.llm.near_dedup import op4_near_dedup
from tidemark.llm.parity_join import op13_ngram_join
from tidemark.llm.quality import OP6_SQL, op6_quality
from tidemark.llm.repeats import op10_repeats
from tidemark.llm.resampling import OP11_SQL, op11_importance_resampling
from tidemark.llm.secrets import op5_secrets
from tidemark.llm.token_counts import op1_token_counts
from tidemark.llm.toxicity import op9_toxicity
from tidemark.llm.warc import op7_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_licenses": op2_licenses,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_repeats": op10_repeats,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_ngram_join": op13_ngram_join,
}
ORACLE_SQL: dict[str, str] = {"op2_licenses": OP2_SQL, "op6_quality": OP6_SQL, "op11_importance_resampling": OP11_SQL, "op12_filter_interactions": OP12_SQL}
