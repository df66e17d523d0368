"""Column expressions: binning, calendar, geography."""
