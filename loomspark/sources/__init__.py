"""Listings, stored tables and line formats."""
