"""Watermarks drawn on pictures: definitions, placement, rendering, painting, and those that files carry."""
