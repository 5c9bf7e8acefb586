"""Registered queries: name -> (callable, oracle SQL or None)."""
