"""Training-data operators: chat formatting, token counts, deduplication,
encoding, language ID, vector search, decontamination, license and URL
scans. Nothing else in the library imports this subpackage."""
