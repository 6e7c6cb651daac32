"""Column functions: money, dates, text rules."""
