"""Operators on ratings, attempts and topic labels; each takes and returns DataFrames."""
