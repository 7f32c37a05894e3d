"""Operators that plan before they act."""
