"""Writers: append, export, per-document JSON, reports and table creation."""
