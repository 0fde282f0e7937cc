"""functions of the sequence-binning engine."""
