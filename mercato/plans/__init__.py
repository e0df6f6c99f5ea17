"""Staging tables, marts and dashboard figures as DataFrame plans."""
