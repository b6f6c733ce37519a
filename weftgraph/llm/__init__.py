"""Operators of the training-text pipeline; nothing outside this folder imports it."""
