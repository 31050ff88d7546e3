"""Training-data preparation operators: counting, searching, filtering, deduplicating and mixing text corpora."""
