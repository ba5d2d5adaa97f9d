"""The registered queries of this subpackage and their SQL."""

from larkspur.llm import chat, decontaminate, jaccard, langid, lexical, line_dedup, neighbours, pieces, suffix_dedup, token_counts, toxicity, url_filter, vector_codes

QUERIES = {f.__name__: f for f in (url_filter.op1_url_filter, decontaminate.op2_decontaminate, chat.op3_chat_format, toxicity.op4_toxicity, pieces.op5_sentencepiece, langid.op6_language_id, neighbours.op7_neighbours, token_counts.op8_token_counts, suffix_dedup.op9_suffix_dedup, jaccard.op10_jaccard_join, lexical.op11_lexical_search, vector_codes.op12_vector_codes, line_dedup.op13_line_dedup)}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op3_chat_format": chat.ORACLE, "op9_suffix_dedup": suffix_dedup.ORACLE, "op10_jaccard_join": jaccard.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_line_dedup": line_dedup.ORACLE}
