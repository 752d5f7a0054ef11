"""Training-data operators: filters, deduplication, mixing, tokenisation and scoring of documents."""
