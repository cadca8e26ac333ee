"""Operations of a training-data pipeline: filters, deduplication, tokens, mixing and search."""
