"""Readers of text and term counts."""
