"""Training-data operators: deduplication, extraction, scoring, mixing and tokenising.

Nothing outside this subpackage imports it; ``varloom.llm.queries`` holds the
registered queries and their SQL.
"""
