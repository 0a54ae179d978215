"""Named queries over the given tables, each with its reference SQL where one exists."""
