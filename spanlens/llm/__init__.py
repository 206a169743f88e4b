"""Training-data operators: filtering, near-duplicate search, mixing, packing and scoring of documents."""
