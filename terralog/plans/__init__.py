"""Multi-step queries composed from the operators."""
