"""The queries of the subpackage and their SQL."""

from helixspark.llm import bpe, html_extraction, line_dedup, media, mixing, ngram_join, token_counts, top_k, toxicity, warc

MODULES = (media, ngram_join, top_k, toxicity, mixing, warc, token_counts, bpe, line_dedup, html_extraction)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
