"""Writers of training data sets and media."""
