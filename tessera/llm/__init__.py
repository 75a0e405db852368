"""Training-data operators: deduplication, cleaning, scoring, mixing, search and tokenisation."""
