"""Operators over statements, transactions and their derived tables."""
