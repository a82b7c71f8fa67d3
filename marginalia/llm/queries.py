"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from . import compaction, decontaminate, exact_dedup, host_reputation, merkle, packing, secrets, simhash, substring_dedup, token_files, toxicity, vector_codes, warc

QUERIES = {
    "op1_retrieval_packing": packing.op1_retrieval_packing,
    "op2_toxicity_gbt": toxicity.op2_toxicity_gbt,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_secret_linking": secrets.op4_secret_linking,
    "op5_host_reputation": host_reputation.op5_host_reputation,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_tiered_compaction": compaction.op7_tiered_compaction,
    "op8_simhash_vptree": simhash.op8_simhash_vptree,
    "op9_warc": warc.op9_warc,
    "op10_template_decontamination": decontaminate.op10_template_decontamination,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_token_files": token_files.op13_token_files,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_host_reputation": host_reputation.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_tiered_compaction": compaction.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
