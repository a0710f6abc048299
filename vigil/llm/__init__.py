"""Corpus operators for training-data pipelines over document, page and
label tables. Nothing outside this subpackage imports it."""
