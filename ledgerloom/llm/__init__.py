"""Operators for preparing training text: names, survivors, pieces, mappings, containers, leaks and languages.

Nothing outside this folder imports it; the rest of the library works without it.
"""
