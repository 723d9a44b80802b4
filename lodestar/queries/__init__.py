"""One query for each inventory row, beside its SQL."""
