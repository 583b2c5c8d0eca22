"""Operators of a training-data pipeline; see the README for the method behind each."""
