"""Constructors."""
