"""foliograde: checked, scored records out of large tables of document text."""
