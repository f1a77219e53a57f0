"""Registered queries, their SQL counterparts and multi-step flows."""
