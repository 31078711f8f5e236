"""Column functions: Catalyst expressions where a value is isolated, Arrow kernels where a document must be parsed."""
