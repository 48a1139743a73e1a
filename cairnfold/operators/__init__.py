"""Relational and stateful operators on traces."""
