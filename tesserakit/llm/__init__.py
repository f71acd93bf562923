"""Operations of a large training-data pipeline: quality, deduplication, mixing, tokens, search."""
