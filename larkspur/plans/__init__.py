"""Pipeline definitions, their compilation to DataFrame plans, and runs."""
