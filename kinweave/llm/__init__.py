"""Training-data operators: tokenising, toxicity, licences, sharding, near-duplicates, PII, decontamination, chat, substrings."""
