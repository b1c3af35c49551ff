"""Fixtures of the training-data operators; the session comes from the outer folder."""
