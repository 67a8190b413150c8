"""Training-data operators: packing, quality, secrets, near-duplicates, toxicity, HTML, WARC, PII, embeddings, mixing."""
