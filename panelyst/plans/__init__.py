"""The whole study as configuration plus a few jobs: derive, report, test."""
