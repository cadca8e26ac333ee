"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from seqloom.llm.bytebpe import op10_bpe
from seqloom.llm.fingerprint import op5_fingerprint
from seqloom.llm.hardneg import OP12_SQL, op12_hard_negatives
from seqloom.llm.langid import op8_language_id
from seqloom.llm.minhash import OP13_SQL, op13_minhash
from seqloom.llm.mixing import OP6_SQL, op6_mix_sources
from seqloom.llm.neighbours import op7_nearest
from seqloom.llm.simhash import op9_simhash
from seqloom.llm.substrings import op3_suffix_dedup
from seqloom.llm.token_counts import op4_token_counts
from seqloom.llm.token_files import op2_token_files
from seqloom.llm.trie import OP11_SQL, op11_prefix_trie
from seqloom.llm.url_filter import op1_url_filter

_ALL = (
    op1_url_filter, op2_token_files, op3_suffix_dedup, op4_token_counts, op5_fingerprint, op6_mix_sources, op7_nearest, op8_language_id, op9_simhash, op10_bpe,
    op11_prefix_trie, op12_hard_negatives, op13_minhash,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op6_mix_sources": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_minhash": OP13_SQL}
