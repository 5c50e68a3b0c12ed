"""Clustering of arriving scans (an extension; one file, one cloud)."""
