"""Registered queries: each plan as a DataFrame function with its oracle SQL."""
