"""Step selection, folds, classification, report and formatting."""
