"""Corridora: indoor-map, walk-timing and corpus analytics on PySpark DataFrames."""
