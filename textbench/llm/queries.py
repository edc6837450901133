"""The dealt operators as queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textbench.llm.conversation_repair import op11_conversation_repair
from textbench.llm.decontaminate import OP6_SQL, op6_decontamination
from textbench.llm.fingerprints import op1_fingerprints
from textbench.llm.language import op10_language
from textbench.llm.licenses import op2_licenses
from textbench.llm.near_dedup import op3_near_dedup
from textbench.llm.packing import op4_packing
from textbench.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from textbench.llm.quality import op7_quality
from textbench.llm.secrets import op5_secrets
from textbench.llm.substrings import OP8_SQL, op8_substring_dedup
from textbench.llm.toxicity import op9_toxicity
from textbench.llm.vector_dedup import OP12_SQL, op12_vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_licenses": op2_licenses,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op6_decontamination": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op12_vector_dedup": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
