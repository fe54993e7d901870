"""Training-data operators: deduplication, search, language, secrets, scoring, tokens, archives."""
