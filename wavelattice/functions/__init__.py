"""Column functions on signals and numpy kernels for Arrow batches."""
