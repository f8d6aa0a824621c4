"""Reading registers, tables, nested answers and change feeds."""
