"""Registry of the training-data queries and their DuckDB equivalents."""

from __future__ import annotations

from detlens.llm import contamination, hostrules, linechunks, mixing, neardup, nsbounds, passages, prefixtrie, secrets, sharding, tokens, toxicity, warc

QUERIES = {
    "op1_secret_forest": secrets.op1_secret_forest,
    "op2_chained_passages": passages.op2_chained_passages,
    "op10_line_chunks": linechunks.op10_line_chunks,
    "op6_toxicity_bigru": toxicity.op6_toxicity_bigru,
    "op8_huffman_tokens": tokens.op8_huffman_tokens,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op3_warc_salvage": warc.op3_warc_salvage,
    "op7_host_rules": hostrules.op7_host_rules,
    "op9_minhash_hamming": neardup.op9_minhash_hamming,
    "op4_decontaminate": contamination.op4_decontaminate,
    "op11_ns_bounds": nsbounds.op11_ns_bounds,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_rendezvous_shards": sharding.op13_rendezvous_shards,
}

SQL = {
    "op10_line_chunks": linechunks.OP10_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op3_warc_salvage": warc.OP3_SQL,
    "op7_host_rules": hostrules.OP7_SQL,
    "op9_minhash_hamming": neardup.OP9_SQL,
    "op4_decontaminate": contamination.OP4_SQL,
    "op11_ns_bounds": nsbounds.OP11_SQL,
    "op12_prefix_trie": prefixtrie.OP12_SQL,
    "op13_rendezvous_shards": sharding.OP13_SQL,
}
