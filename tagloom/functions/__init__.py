"""Column expressions: text, vectors, tokens and ratios. All stay in the JVM."""
