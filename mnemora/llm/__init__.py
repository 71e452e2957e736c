"""Training-data operators (toxicity, media, token files, packing, BPE, fingerprints, PII,
near-duplicates, chat templates, language-model scores). Nothing else in the library imports this."""
