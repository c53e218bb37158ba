"""Training-data operators: near duplicates, tokens, licences, media, packing, quality, sampling, archives, toxicity.

Every operator takes ``documents``-like DataFrames (``doc_id``, ``text``, any
other columns) and returns DataFrames.  Nothing else in the library imports this
subpackage.  Conventions shared by all operators: a null text counts as the
empty text, rows with equal or null ``doc_id`` are separate rows, extra columns
are ignored by queries and kept by filters.
"""
