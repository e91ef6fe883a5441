"""Operators for preparing training text at corpus scale.

Self-contained: nothing else in the library imports this subpackage, and it
imports nothing from the rest of the library.
"""
