"""Operators for training data: truncation, hidden copies, split overlap, top N, broken pairs, token ids, leaks, garbling."""
