"""Reading and publishing files."""
