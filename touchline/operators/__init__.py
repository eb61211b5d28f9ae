"""Relational operators over the typed match view and the tables beside it."""
