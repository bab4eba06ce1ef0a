"""Column functions: text, hashes, turns and model responses."""
