"""Training-data operators: tokenising, scoring, matching, filtering and packing text corpora."""
