"""The queries of this subpackage and their SQL twins."""

from tallyspark.llm import chat, extraction, fingerprint, language, mixing, neardup, packing, phrases, ranking, search, secrets, suffixes, warc

QUERIES = {
    "op1_language_id": language.query,
    "op2_html_extraction": extraction.query,
    "op3_near_duplicates": neardup.query,
    "op4_best_fit_packing": packing.query,
    "op5_document_fingerprints": fingerprint.query,
    "op6_exact_topk": search.query,
    "op7_warc_archives": warc.query,
    "op8_secret_scans": secrets.query,
    "op9_chat_formatting": chat.query,
    "op10_source_mixing": mixing.query,
    "op11_ranked_search": ranking.query,
    "op12_suffix_dedup": suffixes.query,
    "op13_phrase_mining": phrases.query,
}

ORACLE: dict[str, str] = {"op6_exact_topk": search.SQL, "op11_ranked_search": ranking.SQL, "op13_phrase_mining": phrases.SQL}
