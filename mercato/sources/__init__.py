"""Raw tables in, staging tables, views and exports out."""
