"""Operators from DataFrames to DataFrames: endpoints, MAC tables, the ladder, graphs, walks, devices, crawls."""
