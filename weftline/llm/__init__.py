"""Training-data operators: packing, token files, quality, near and exact dedup, scoring, decontamination."""
