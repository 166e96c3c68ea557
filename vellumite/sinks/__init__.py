"""Writers: Markdown, PNG, PDF, zip archives."""
