"""Operators over a token stream: reading, sampling, mixtures, statistics, checks."""
