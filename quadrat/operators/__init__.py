"""Relational operators over annotation tables; each takes and returns DataFrames and is lazy."""
