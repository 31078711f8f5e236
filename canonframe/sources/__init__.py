"""Reading documents and writing canonical ones."""
