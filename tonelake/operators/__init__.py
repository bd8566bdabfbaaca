"""DataFrame-to-DataFrame operators; every function takes column names, so it fits any schema."""
