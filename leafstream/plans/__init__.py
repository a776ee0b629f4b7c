"""Ready-made queries over the tables of a run, and the SQL that checks them."""
