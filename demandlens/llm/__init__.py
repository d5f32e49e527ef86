"""Training-data operators: filtering, de-duplication, formatting, mixing, scoring.

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
