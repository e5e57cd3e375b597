"""Scalar expressions that Spark has under another name or not at all."""
