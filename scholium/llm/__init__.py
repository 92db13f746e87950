"""Training-data operators: filtering, de-duplication, tokenizing, packing, search.

Nothing else in the library imports this subpackage. ``queries`` holds the thin
registered queries, every other module one operator with its own interface.
"""
