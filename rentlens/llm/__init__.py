"""Training-data operators: deduplication, filtering, mixing, search, formatting and tokenisation.

Nothing else in the library imports this subpackage. Its registered queries are
in ``rentlens.llm.queries``.
"""
