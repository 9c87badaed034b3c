"""Training-data operators: language ID, extraction, dedup, packing, fingerprints, search, archives, secrets, chat, mixing."""
