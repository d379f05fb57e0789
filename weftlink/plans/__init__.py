"""Query plans over whole tables and their registry."""
