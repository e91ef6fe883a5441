"""Registered queries of the library and the SQL with the same results."""
