"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trunkwatch.llm.bpe import op7_bpe
from trunkwatch.llm.decontaminate import op10_decontaminate
from trunkwatch.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from trunkwatch.llm.html_text import op8_html_text
from trunkwatch.llm.nearest import op13_nearest
from trunkwatch.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from trunkwatch.llm.simhash import op1_simhash_near_dedup
from trunkwatch.llm.suffix_dedup import op3_suffix_dedup
from trunkwatch.llm.token_counts import op2_token_counts
from trunkwatch.llm.token_shards import op4_token_shards
from trunkwatch.llm.toxicity import op5_toxicity
from trunkwatch.llm.url_filter import OP6_SQL, op6_url_filter
from trunkwatch.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_shards": op4_token_shards,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_bpe": op7_bpe,
    "op8_html_text": op8_html_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_nearest": op13_nearest,
}

ORACLES: dict[str, str] = {
    "op6_url_filter": OP6_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
