"""Catalogs that grow while files arrive."""
