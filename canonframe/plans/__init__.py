"""Queries over the driver's tables that exercise every operator, with independent SQL for their results."""
