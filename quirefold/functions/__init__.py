"""Subpackage of quirefold."""
