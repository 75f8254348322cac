"""Column functions: no shuffle, usable on batch and streaming frames alike."""
