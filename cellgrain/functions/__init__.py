"""Row-wise column expressions: every function maps Column -> Column."""
