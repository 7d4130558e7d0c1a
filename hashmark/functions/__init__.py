"""Column-level helpers: keys, missing values, pricing and scoring expressions."""
