"""Session set-up, shared-folder tables, and the registered queries with their SQL."""
