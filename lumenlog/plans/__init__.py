"""Registered queries: each module offers ``QUERIES`` and ``ORACLES``."""
