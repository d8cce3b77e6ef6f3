"""Delimited input and output."""
