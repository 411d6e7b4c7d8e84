"""Listing media, reading byte ranges, and writing catalogs and clips."""
