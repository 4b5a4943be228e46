"""Training-data operators: extraction, tokenizing, scoring, filtering, duplicates and mixing."""
