"""Readers and writers: JSON lines, CoNLL-U, Hunspell, nested JSON, deterministic and atomic files."""
