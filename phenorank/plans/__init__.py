"""Query plans built from the operators, with their SQL counterparts."""
