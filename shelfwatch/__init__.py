"""Catalog change intelligence on Spark: DataFrame in, DataFrame out.

Nothing in this package starts a session, collects rows to the driver or keeps
state of its own. Every use of "now" is an explicit ``as_of`` argument.
"""
