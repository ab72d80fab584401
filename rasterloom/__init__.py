"""Keyed, reversible image scrambling and image-metadata analytics as DataFrames."""
