"""Column functions: text parsing, normalising and masking."""
