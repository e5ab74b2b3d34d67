"""Relational, graph and iterative operators."""
