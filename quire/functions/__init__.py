"""SQL functions and table functions over PDF bytes."""
