"""Sources: files to documents (text, title, metadata, sections)."""
