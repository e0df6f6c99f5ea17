"""Column functions: exact arithmetic, calendar, geography, business rules."""
