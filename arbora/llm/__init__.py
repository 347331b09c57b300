"""Training-data operators: dedup, filtering, tokenising, packing and search over large corpora.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
