"""Where documents, rules and logs come from, and where results go."""
