"""The queries of this folder and the SQL that some can be held against."""

from __future__ import annotations

from . import alignment, ann, automaton, divergence, langid, licenses, mixing, ngramjoin, packing, syncmers, tokencount, toxicity, urlfilter

QUERIES = {
    "op1_token_counts": tokencount.query,
    "op2_nearest": ann.query,
    "op3_mixing": mixing.query,
    "op4_url_filter": urlfilter.query,
    "op5_licenses": licenses.query,
    "op6_syncmers": syncmers.query,
    "op7_packing": packing.query,
    "op8_language": langid.query,
    "op9_ngram_join": ngramjoin.query,
    "op10_toxicity": toxicity.query,
    "op11_alignment": alignment.query,
    "op12_divergence": divergence.query,
    "op13_bpe_automaton": automaton.query,
}

ORACLES = {"op4_url_filter": urlfilter.ORACLE_SQL, "op12_divergence": divergence.ORACLE_SQL}
