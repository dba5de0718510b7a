"""Compositions over concrete tables: inputs derived from the star schema, and the registered queries."""
