"""Reading tables, key scans and document sources; writing results."""
