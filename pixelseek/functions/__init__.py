"""Column functions on vectors, portable hashing and the Arrow batch kernels."""
