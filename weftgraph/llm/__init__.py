"""Training-data operators: ten corpus passes that nothing else in the library imports."""
