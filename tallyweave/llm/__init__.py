"""Operators for preparing large training corpora and entity tables."""
