"""Registered queries on the test tables, each next to the SQL that checks it."""
