"""Reusable DataFrame operators (joins, windows, grids, quality, reshaping)."""
