"""Composed analyses: predictions, reviews, bets, combinations."""
