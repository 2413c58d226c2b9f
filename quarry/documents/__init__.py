"""Markdown documents: sections, chunks, tables and cleanup."""
