"""Registered queries: operators applied to tables derived from the driver's."""
