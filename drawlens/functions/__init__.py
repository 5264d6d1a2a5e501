"""Column functions for sets of numbers: all built-in expressions, none leaves the JVM."""
