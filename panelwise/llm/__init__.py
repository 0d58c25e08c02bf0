"""Operators for building training data: tokenizers, packing, near-duplicate detection,
quality rules, main-text extraction, repeated-passage removal, language-model scores, importance
resampling, alignment of tokenizers and document fingerprints.

Nothing else in the library imports this subpackage.  ``catalog`` registers its queries.
"""
