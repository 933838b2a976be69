"""Stateful and windowed stream jobs."""
