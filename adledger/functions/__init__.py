"""Pure column functions: Column in, Column out, no Python on the data path."""
