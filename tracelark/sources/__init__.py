"""Scans: parquet tables, JSON lines, JSON objects, file trees, office documents."""
