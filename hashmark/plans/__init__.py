"""Compositions of the operators: datasets, feature frames, backtests, weekly slates."""
