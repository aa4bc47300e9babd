"""Registered queries: the package applied to order-and-supplier tables that stand in for territory and registry data."""
