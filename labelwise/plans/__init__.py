"""Registered queries: operators bound to the given tables, with oracle SQL."""
