"""Reading and saving tables."""
