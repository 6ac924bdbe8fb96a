"""Discourse-to-market analytics expressed as Spark DataFrame transformations."""
