"""Storage, test views and sources."""
