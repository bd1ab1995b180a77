"""Views over the given tables, registered queries and their SQL."""
