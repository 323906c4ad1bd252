"""Structured Streaming forms: weekly bars with late sessions, and the breakout fold with state between batches."""
