"""Whole jobs: extract, crawl, refine, train."""
