"""Column functions: lexicon, normalization, arithmetic, gates, verification, calibration."""
