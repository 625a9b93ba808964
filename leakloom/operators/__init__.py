"""Operators: the registry, the detect stage, states and roll-ups."""
