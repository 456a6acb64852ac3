"""Table readers, writers and the canonical retail frames."""
