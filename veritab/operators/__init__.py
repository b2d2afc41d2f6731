"""Relational operators of the decision engine."""
