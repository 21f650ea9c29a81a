"""Ready-made plans: views over the star schema, queries and their SQL, settings."""
