"""Training-data operators: thirteen corpus-scale components and their queries.

Nothing else in the library imports this subpackage.
"""
