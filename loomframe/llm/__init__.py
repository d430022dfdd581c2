"""Training-data operators: deduplication, decontamination, filtering, scoring and mixing of text tables."""
