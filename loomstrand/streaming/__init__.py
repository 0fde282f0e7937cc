"""streaming of the sequence-binning engine."""
