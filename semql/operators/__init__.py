"""Semantic scans, joins and nearest-neighbour search over DataFrames."""
