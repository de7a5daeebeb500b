"""Rules over a log of fits, scores and cross-validations."""
