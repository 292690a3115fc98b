"""Column expressions and array kernels without Spark plans of their own."""
