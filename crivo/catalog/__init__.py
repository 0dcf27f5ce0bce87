"""Registered queries and the SQL that checks them, one module per area."""
