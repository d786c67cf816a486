"""Column expressions: bits, images, similarities, text."""
