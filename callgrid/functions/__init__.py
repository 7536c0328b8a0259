"""Column functions: `native` stays in the JVM, `vectorized` runs over Arrow batches."""
