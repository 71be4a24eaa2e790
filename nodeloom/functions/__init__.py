"""Column functions: vectors, geometry, basis expansions, schedules."""
