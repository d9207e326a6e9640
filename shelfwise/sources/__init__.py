"""Readers for the source tables and the dated interaction snapshot."""
