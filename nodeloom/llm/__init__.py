"""Operators for preparing text corpora and media at scale. Nothing else in the library imports this subpackage."""
