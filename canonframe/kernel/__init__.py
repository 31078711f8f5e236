"""Per-document kernels: pure, re-entrant Python functions over one document, lifted to columns in canonframe.functions."""
