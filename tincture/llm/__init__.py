"""Training-data operators: deduplication, filters, classifiers and tokenization over document tables."""
