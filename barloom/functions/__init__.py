"""Column functions with the null, NaN and division rules of bar series."""
