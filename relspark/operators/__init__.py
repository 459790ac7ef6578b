"""Row changes and integrity checks as DataFrame operations."""
