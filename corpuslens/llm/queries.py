"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from corpuslens.llm import bpe, divergence, exact_dedup, filter_audit, lines, minhash, mixing, pieces, substring, toxicity, url_lists, vectors, warc

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_vector_near_dedup": vectors.op2_vector_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_warc": warc.op5_warc,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_url_lists": url_lists.op8_url_lists,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

SQL = {
    "op1_minhash_near_dedup": minhash.SQL,
    "op2_vector_near_dedup": vectors.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_warc": warc.SQL,
    "op6_substring_dedup": substring.SQL,
    "op8_url_lists": url_lists.SQL,
    "op9_source_mixing": mixing.SQL,
    "op10_line_dedup": lines.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
