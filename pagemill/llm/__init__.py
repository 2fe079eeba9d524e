"""Training-data operators: one module each; nothing else in the library imports this subpackage."""
