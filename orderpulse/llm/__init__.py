"""Training-data operators: tokenizing, language, mixing, privacy, quality, secrets, dedup, fixity."""
