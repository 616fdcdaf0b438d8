"""Reading captured pages, extracting cards from them, and writing exports."""
