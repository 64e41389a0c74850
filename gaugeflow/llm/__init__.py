"""Operations of a training-data pipeline: filters, tokenizers, searches and deduplication over documents."""
