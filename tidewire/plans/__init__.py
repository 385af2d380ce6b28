"""Registered queries, their SQL counterparts and session settings."""
