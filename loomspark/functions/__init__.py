"""Column functions: text, identity, hashes, numbers."""
