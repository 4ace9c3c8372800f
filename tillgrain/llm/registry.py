"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tillgrain.llm.bytebpe import op5_chunked_bpe
from tillgrain.llm.chosenpath import op8_chosen_path
from tillgrain.llm.crf import op10_crf_language
from tillgrain.llm.digests import OP2_SQL, op2_digest_index
from tillgrain.llm.lexical import OP12_SQL, op12_mask_search
from tillgrain.llm.mixing import op3_fair_mix
from tillgrain.llm.perplexity import op7_quality_rules
from tillgrain.llm.quantised import OP11_SQL, op11_int8_tiles
from tillgrain.llm.repeats import op9_window_dedup
from tillgrain.llm.runindex import op4_run_length_dedup
from tillgrain.llm.secrets import op6_layered_secrets
from tillgrain.llm.spelling import op13_spelling_trie
from tillgrain.llm.wavelet import op1_wavelet_shards

QUERIES = {
    "op1_wavelet_shards": op1_wavelet_shards,
    "op2_digest_index": op2_digest_index,
    "op3_fair_mix": op3_fair_mix,
    "op4_run_length_dedup": op4_run_length_dedup,
    "op5_chunked_bpe": op5_chunked_bpe,
    "op6_layered_secrets": op6_layered_secrets,
    "op7_quality_rules": op7_quality_rules,
    "op8_chosen_path": op8_chosen_path,
    "op9_window_dedup": op9_window_dedup,
    "op10_crf_language": op10_crf_language,
    "op11_int8_tiles": op11_int8_tiles,
    "op12_mask_search": op12_mask_search,
    "op13_spelling_trie": op13_spelling_trie,
}

ORACLES = {"op2_digest_index": OP2_SQL, "op11_int8_tiles": OP11_SQL, "op12_mask_search": OP12_SQL}
