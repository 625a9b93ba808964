"""Functions on values and columns."""
