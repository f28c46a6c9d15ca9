"""Operators for building language-model training data from tables of documents."""
