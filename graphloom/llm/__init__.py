"""Training-data operators: near duplicates, packing, mixing, privacy, extraction, chat, quality."""
