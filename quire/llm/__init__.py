"""Operators for preparing training data: filters, near-duplicates, neighbours, encoders and writers."""
