"""Part of the weftlink engine: streaming."""
