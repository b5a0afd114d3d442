"""Fixed rule tables and column expressions."""
