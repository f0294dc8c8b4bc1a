"""Typed questions over facts, composed of the operators."""
