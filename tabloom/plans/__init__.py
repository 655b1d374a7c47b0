"""SQL access, log analytics and the catalogue of queries."""
