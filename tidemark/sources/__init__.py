"""Reading and cleaning source tables and change logs."""
