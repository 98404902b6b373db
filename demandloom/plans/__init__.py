"""End-to-end compositions of the operators, and the registered queries with their oracle SQL."""
