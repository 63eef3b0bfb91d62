"""Registered queries: operators applied to the derived networks."""
