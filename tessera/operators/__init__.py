"""tessera operators."""
