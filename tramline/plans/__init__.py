"""Domain tables and the catalogue of queries."""
