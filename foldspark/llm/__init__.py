"""Operators for large-scale training-data preparation.

Each module holds one operator with its own general interface; ``queries``
applies them to the tables of the data folder.  Nothing outside this
subpackage imports it.
"""
