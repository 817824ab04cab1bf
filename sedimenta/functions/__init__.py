"""Column functions and schema edit scripts."""
