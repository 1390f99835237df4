"""Volumes, label maps and corpora as DataFrames."""
