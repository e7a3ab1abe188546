"""Operators for preparing text corpora: filtering, de-duplication, encoding and scoring."""
