"""The kernels are stateless, so they work on streams as on tables."""
