"""Part of the layout engine."""
