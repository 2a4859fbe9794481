"""Registered queries with the SQL that they are compared with."""
