"""Tables of the memory model, benchmark files, caches and dumps."""
