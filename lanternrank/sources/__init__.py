"""Reading records and the tables that evaluations hand on."""
