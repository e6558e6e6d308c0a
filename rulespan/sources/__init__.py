"""Readers and writers for tables, rule catalogues, results and the text corpus."""
