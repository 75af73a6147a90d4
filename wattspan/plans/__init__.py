"""Query specifications, hooks and the engine facade."""
