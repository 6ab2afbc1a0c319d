"""Operators for building language-model training corpora; nothing else imports this package."""
