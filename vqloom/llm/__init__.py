"""Training-data operators: media, toxicity, dedup, PII, tokenising, HTML, mixing and LM scoring."""
