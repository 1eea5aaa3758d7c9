"""Symbol, import and call extraction with the standard library only."""
