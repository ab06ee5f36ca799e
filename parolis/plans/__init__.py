"""Named queries over the driver tables, with the SQL each is checked against."""
