"""Training-data operators: language id, tokenizers, near-dedup, chat formatting,
token files, decontamination, personal data and quality filters."""
