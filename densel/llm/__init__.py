"""Operations for building language-model training data: archives, deduplication, extraction, filters, mixing."""
