"""plans of the sequence-binning engine."""
