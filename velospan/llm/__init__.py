"""Operators over training text: one module each, their queries in ``queries``."""
