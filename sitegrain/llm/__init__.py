"""Training-data operators and their registered queries. Nothing else in the library imports this package."""
