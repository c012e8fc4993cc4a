"""Readers and generators of price panels."""
