"""Column expressions, and the plain rules behind Arrow batches."""
