"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from triage_spark.llm import op1_line_dedup, op2_source_mix, op10_url_filter, op11_prefix_trie, op12_hash_tree
from triage_spark.llm.op3_bpe_tree import op3_bpe_tree
from triage_spark.llm.op4_ann_graph import op4_ann_graph
from triage_spark.llm.op5_toxicity import op5_toxicity
from triage_spark.llm.op6_token_files import op6_token_files
from triage_spark.llm.op7_chat_format import op7_chat_format
from triage_spark.llm.op8_fingerprints import op8_fingerprints
from triage_spark.llm.op9_near_dedup import op9_near_dedup
from triage_spark.llm.op13_token_align import op13_token_align

QUERIES = {
    "op1_line_dedup": op1_line_dedup.op1_line_dedup,
    "op2_source_mix": op2_source_mix.op2_source_mix,
    "op3_bpe_tree": op3_bpe_tree,
    "op4_ann_graph": op4_ann_graph,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_chat_format": op7_chat_format,
    "op8_fingerprints": op8_fingerprints,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter.op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie.op11_prefix_trie,
    "op12_hash_tree": op12_hash_tree.op12_hash_tree,
    "op13_token_align": op13_token_align,
}

#: Queries that SQL cannot express are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_line_dedup": op1_line_dedup.ORACLE_SQL,
    "op2_source_mix": op2_source_mix.ORACLE_SQL,
    "op10_url_filter": op10_url_filter.ORACLE_SQL,
    "op11_prefix_trie": op11_prefix_trie.ORACLE_SQL,
    "op12_hash_tree": op12_hash_tree.ORACLE_SQL,
}
