"""Density clustering of point clouds and corpus preparation on Spark."""
