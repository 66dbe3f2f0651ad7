"""tessera plans."""
