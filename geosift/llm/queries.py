"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from geosift.llm import byte_bpe, conversations, decontaminate, embeddings, html_text, jaccard, licenses, mixing, search, secrets, token_output, toxicity, wordpiece

QUERIES = {
    "op6_html_text": html_text.op6_html_text,
    "op2_embedding_duplicates": embeddings.op2_embedding_duplicates,
    "op4_token_counts": wordpiece.op4_token_counts,
    "op9_license_scan": licenses.op9_license_scan,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op8_token_ids": token_output.op8_token_ids,
    "op1_toxicity": toxicity.op1_toxicity,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLE_SQL = {
    "op2_embedding_duplicates": embeddings.OP2_SQL,
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op12_ranked_search": search.OP12_SQL,
}
