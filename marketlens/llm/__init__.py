"""Training-data operators. Nothing else in the library imports this
subpackage; ``queries.py`` holds its registered queries."""
