"""Structured Streaming forms of the daily jobs.

Every sink is idempotent per batch id, so a batch that runs again after a lost
executor or driver leaves the same tables behind.
"""
