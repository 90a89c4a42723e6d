"""Queries that bind the operators to the given tables, and the SQL that checks them."""
