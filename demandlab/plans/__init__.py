"""Domain chains built from the operators: facts, series, features,
forecasts and reporting.  Each function returns a lazy DataFrame."""
