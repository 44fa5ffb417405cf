"""The queries of this package and, where SQL can express one, the same result as SQL."""

from __future__ import annotations

from rowtide.llm import align, bpe, chat, decontaminate, language, merkle, packing, simhash, substring, toxicity, urllists, vafile, warc

QUERIES = {
    "op1_substring_dedup": substring.query,
    "op2_prefix_targets": chat.query,
    "op3_exact_top_k": vafile.query,
    "op4_packing": packing.query,
    "op5_decontamination": decontaminate.query,
    "op6_url_lists": urllists.query,
    "op7_language": language.query,
    "op8_warc": warc.query,
    "op9_toxicity": toxicity.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_bpe": bpe.query,
    "op12_token_alignment": align.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLE = {
    "op2_prefix_targets": chat.SQL,
    "op3_exact_top_k": vafile.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op6_url_lists": urllists.SQL,
    "op8_warc": warc.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
