"""Congestion analytics over gridded mobile-network activity, as plain PySpark functions."""
