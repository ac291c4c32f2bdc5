"""Library tables in, document tables and exports out."""
