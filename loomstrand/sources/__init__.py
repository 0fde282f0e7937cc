"""sources of the sequence-binning engine."""
