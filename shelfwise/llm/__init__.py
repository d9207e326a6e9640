"""Operators for preparing training data: packing, scoring, licences, quality, mixing, de-duplication, search."""
