"""Settings of a run and the catalogue of queries."""
