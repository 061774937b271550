"""Scalar functions over payloads, texts and times."""
