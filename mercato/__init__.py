"""Marketplace analytics as PySpark DataFrame jobs.

Eight raw tables become a star schema (four dimensions and an order-item
fact); eight marts and the dashboard figures are computed from the star.
"""
