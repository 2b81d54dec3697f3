"""Registered queries: each applies operators of this library to the given tables, next to the SQL it must agree with."""
