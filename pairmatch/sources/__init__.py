"""Table readers, writers and the views derived from the shared test tables."""
