"""Where cases and scopes come from and where reports go."""
