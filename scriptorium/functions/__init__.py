"""Column functions: text rules, sizes, previews, keys."""
