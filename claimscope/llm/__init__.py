"""Training-data operators: packing, near-duplicates, quality, WARC, scoring, decontamination, extraction, token files."""
