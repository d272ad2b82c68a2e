"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import boosting, decision_list, decontaminate, fim, hilbert, hmm, langmix, licenses, linechunks, manifest, prefixforest, sentencepieces, simhash

QUERIES = {
    "op1_simhash_multi_index": simhash.op1_simhash_multi_index,
    "op2_qgram_decontamination": decontaminate.op2_qgram_decontamination,
    "op3_decision_list": decision_list.op3_decision_list,
    "op4_hilbert_sharding": hilbert.op4_hilbert_sharding,
    "op5_sentencepiece": sentencepieces.op5_sentencepiece,
    "op6_language_mixture": langmix.op6_language_mixture,
    "op7_hidden_markov": hmm.op7_hidden_markov,
    "op8_line_chunks": linechunks.op8_line_chunks,
    "op9_license_digests": licenses.op9_license_digests,
    "op10_boosted_quality": boosting.op10_boosted_quality,
    "op11_marker_injection": fim.op11_marker_injection,
    "op12_event_manifest": manifest.op12_event_manifest,
    "op13_prefix_forest": prefixforest.op13_prefix_forest,
}
ORACLE_SQL = {
    "op9_license_digests": licenses.ORACLE_SQL,
    "op11_marker_injection": fim.ORACLE_SQL,
    "op12_event_manifest": manifest.ORACLE_SQL,
}
