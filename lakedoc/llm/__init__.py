"""Operators for preparing language-model training data; nothing else in lakedoc imports this subpackage."""
