"""Where tables and sources come from."""
