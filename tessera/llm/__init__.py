"""Operators for training-data corpora: each module holds one operator, ``catalog`` their queries and SQL."""
