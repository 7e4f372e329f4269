"""Training-data operators: ten corpus jobs, their queries, and what they share. Nothing else in the library imports this."""
