"""Table schemas, readers, the fixture adapter and the score sink."""
