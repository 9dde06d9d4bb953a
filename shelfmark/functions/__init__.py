"""Column helpers; all of them are native expressions."""
