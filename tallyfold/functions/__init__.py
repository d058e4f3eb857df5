"""Column functions: from columns to a column."""
