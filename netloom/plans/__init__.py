"""Whole plans made of operators: the graph document, and the registered queries with their SQL."""
