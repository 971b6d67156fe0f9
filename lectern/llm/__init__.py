"""Operators for preparing large training corpora: filters, joins, packing and output."""
