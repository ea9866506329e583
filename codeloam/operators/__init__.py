"""Operators on tables of files, commits and edges."""
