"""Point-cloud readers and writers."""
