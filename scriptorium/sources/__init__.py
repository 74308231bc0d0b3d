"""Sources: uploaded files and payloads, the text store, databases."""
