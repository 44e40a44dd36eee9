"""Routes: what is run from end to end, what it checks and what it writes."""
