"""Reading survey files and lookups, saving and exporting results."""
