"""The corpus queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from .best_fit_packing import op13_best_fit_packing
from .byte_bpe import op5_byte_bpe
from .chat_format import OP3_SQL, op3_chat_format
from .decontaminate import OP1_SQL, op1_decontaminate
from .html_extract import op9_html_extract
from .jaccard_join import OP4_SQL, op4_jaccard_join
from .lexical_search import OP11_SQL, op11_lexical_search
from .mtree_search import OP8_SQL, op8_mtree_search
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality_classifier import op7_quality_classifier
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mtree_search": op8_mtree_search,
    "op9_html_extract": op9_html_extract,
    "op10_url_filter": op10_url_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_mtree_search": OP8_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
