"""Scans, endpoints, catalogs and append logs."""
