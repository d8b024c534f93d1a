"""Training-data operators: near-duplicates, toxicity, archives, decontamination, tokens, mixing, personal data, secrets."""
