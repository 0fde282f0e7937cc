"""operators of the sequence-binning engine."""
