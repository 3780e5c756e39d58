"""See the catalogue for the queries that use these."""
