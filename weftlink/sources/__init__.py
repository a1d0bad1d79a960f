"""Part of the weftlink engine: sources."""
