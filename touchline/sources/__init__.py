"""Readers of provider files, the contracts of canonical tables, and the lake that holds them."""
