"""Reading encounter tables and writing results."""
