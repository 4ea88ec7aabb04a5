"""DataFrame operators: cleaning, segmentation, windows, motion, evaluation, audits."""
