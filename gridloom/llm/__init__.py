"""Operators for preparing large-scale training data.

Nothing else in the library imports this subpackage; delete the folder and
the rest keeps working.
"""
