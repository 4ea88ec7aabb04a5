"""Queries over the given tables, one or more per operator, with an SQL form to check them."""
