"""Operators over long tables of counts, sets, vectors and graphs."""
