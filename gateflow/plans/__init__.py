"""Query registry and derived fixtures."""
