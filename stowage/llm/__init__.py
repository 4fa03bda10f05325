"""Training-data operators: quality, toxicity, secrets, HTML, dedup, BPE, chat, mixing, media."""
