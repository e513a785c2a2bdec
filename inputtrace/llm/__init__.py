"""Operators that prepare training text: cleaning, deduplication, tokens. Nothing else imports them."""
