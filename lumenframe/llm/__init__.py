"""Operators for preparing training corpora. Nothing else in lumenframe imports this."""
