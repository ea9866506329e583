"""Recognition of source files by generalised LL parsing."""
