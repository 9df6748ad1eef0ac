"""Registered queries of the core library: one callable and, where SQL can say it, one SQL text per key."""
