"""Column functions and text scanners."""
