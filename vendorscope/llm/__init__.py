"""Training-data operators: dedup, language ID, tokenisation, similarity joins,
language-model scoring, toxicity, packing, WARC writing, embedding near-dedup
and URL rules. One module per operator; ``queries.py`` registers them.
Nothing outside this folder imports it except the guarded driver entry."""
