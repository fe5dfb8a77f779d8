"""Physical operators: star scans, the two join models, solution modifiers."""
