"""Training-data operators: tokenisation, filtering, deduplication, scoring, packing and storage.

Operators on documents take a DataFrame with at least ``doc_id`` and ``text``; those on conversations and pages name their
columns. Further columns, whatever their names, are ignored or carried unchanged as each docstring says. Nothing outside
this subpackage imports it.
"""
