"""Incremental versions of file-fed tables."""
