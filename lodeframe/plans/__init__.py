"""Composed plans: composites, the cross-sectional model, evaluation reports."""
