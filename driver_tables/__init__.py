"""The library's operators run on the driver tables, and the SQL they must equal."""
