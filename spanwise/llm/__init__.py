"""Operators for large training corpora: formatting, labelling, scoring, cleaning and encoding of texts."""
