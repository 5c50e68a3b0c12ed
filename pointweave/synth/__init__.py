"""Synthetic scenes: shapes, placement, noise and labelled output."""
