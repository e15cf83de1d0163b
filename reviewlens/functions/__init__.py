"""Column functions: markup cleaning, text normalisation, formatting, vectors."""
