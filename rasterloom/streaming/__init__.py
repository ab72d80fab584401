"""Structured streams over files."""
