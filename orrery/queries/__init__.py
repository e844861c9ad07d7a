"""Registered queries of the reference operators, each module with QUERIES and ORACLES."""
