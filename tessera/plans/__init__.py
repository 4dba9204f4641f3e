"""Derived fixtures and the registered queries (Spark plan + SQL oracle)."""
