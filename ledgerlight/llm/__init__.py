"""Training-data operators: mixing, filtering, deduplication, scans, language-model scoring, archives.

Nothing outside this subpackage imports it.
"""
