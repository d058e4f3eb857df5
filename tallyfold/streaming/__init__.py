"""Series that arrive file by file."""
