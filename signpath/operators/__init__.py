"""Relational operators on signed graphs."""
