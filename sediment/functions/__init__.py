"""Part of the corpus engine."""
