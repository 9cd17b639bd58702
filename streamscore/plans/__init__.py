"""Test tables, registered queries and their SQL counterparts."""
