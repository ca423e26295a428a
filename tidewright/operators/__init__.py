"""Maintenance operators: change images, summary deltas, scoped recompute, verification."""
