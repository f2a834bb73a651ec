"""Training-data operators: filtering, deduplication, extraction, tokens and packing.

Nothing outside this subpackage imports it; `queries` registers what it offers.
"""
