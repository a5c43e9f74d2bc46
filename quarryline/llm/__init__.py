"""Operators on text for language-model training data; nothing else imports them."""
