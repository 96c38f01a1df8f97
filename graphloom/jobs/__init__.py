"""Jobs and the catalogue of named queries."""
