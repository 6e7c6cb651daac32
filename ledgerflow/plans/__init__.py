"""Registered queries and the ledger view they run on."""
