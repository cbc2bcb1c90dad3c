"""Operators for preparing language-model training data: ten corpus operators, each a Spark job over whole tables."""
