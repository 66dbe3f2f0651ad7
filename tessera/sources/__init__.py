"""tessera sources."""
