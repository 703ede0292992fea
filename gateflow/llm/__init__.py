"""Training-data operators: dedup, filters, tokenisation, formatting, mixing, sharding."""
