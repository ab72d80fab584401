"""Metadata of image files: reading, policies and their application, block by block."""
