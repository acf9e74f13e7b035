"""Wiring of operators into the registered queries and their SQL oracles."""
