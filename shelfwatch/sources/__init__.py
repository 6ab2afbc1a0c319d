"""Scans and sinks: registries, the CSV feed, pages, sitemaps, append targets."""
