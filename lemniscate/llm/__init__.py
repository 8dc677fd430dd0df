"""Training-data operators: filters, deduplication, scoring and tokenisation of document tables."""
