"""Operators over whole tables; every table has a key column, ``doc_id`` by default."""
