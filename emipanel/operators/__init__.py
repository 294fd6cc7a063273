"""DataFrame operators. Each takes its column names as parameters and returns a lazy DataFrame."""
