"""tessera streaming."""
