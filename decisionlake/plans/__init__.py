"""Named queries over the driver tables, with the SQL they are compared with."""
