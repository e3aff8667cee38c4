"""Registered queries, their SQL counterparts and whole jobs."""
