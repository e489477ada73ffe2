"""Listings, catalogs and versioned snapshots."""
