"""Registered queries: operators applied to market views of the driver's tables, each with SQL to check it by."""
