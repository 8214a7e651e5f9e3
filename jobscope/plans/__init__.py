"""Report catalogs (the study over CSV exports, the test-table reports with their
oracle SQL) and plan checks."""
