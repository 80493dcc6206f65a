"""Documents, catalog, analysis and planning: all on the driver, none needs a session."""
