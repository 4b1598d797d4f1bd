"""Operators for large training corpora; see README, section "Training-data operators"."""
