"""Column functions and ordered-data building blocks shared by the operators."""
