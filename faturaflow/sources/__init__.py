"""Sources: files, texts, PDF content and request contexts."""
