"""The three end-to-end jobs."""
