"""The queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from tensorloom.llm import ann, collocations, decontamination, langid, mixing, neardup, packing, quality, ranked_search, secret_scan, sharding, token_io, toxicity

_MODULES = {
    "op1_mix_sources": mixing,
    "op2_rendezvous_shards": sharding,
    "op3_toxicity_ftrl": toxicity,
    "op4_token_files": token_io,
    "op5_pack_windows": packing,
    "op6_secret_scan": secret_scan,
    "op7_language_bayes": langid,
    "op8_near_duplicates": neardup,
    "op9_anisotropic_search": ann,
    "op10_quality_rules": quality,
    "op11_ranked_search": ranked_search,
    "op12_collocations": collocations,
    "op13_decontamination": decontamination,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if module.ORACLE}
