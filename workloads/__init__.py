"""Queries over the driver's tables that exercise every operator, and their SQL twins."""
