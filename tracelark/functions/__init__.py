"""Column functions: Unicode forms, text, hashing, dates, URLs, numbers."""
