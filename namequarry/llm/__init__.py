"""Operators for training data: deduplication, survivors, tokens, mixing and residue. Nothing else imports this package."""
