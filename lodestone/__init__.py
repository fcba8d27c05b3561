"""Analytics for text corpora, search and evaluation on Spark."""
