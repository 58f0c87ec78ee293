"""Query plans over whole tables."""
