"""Whole plans: the query catalogue, the detector and the experiment grid."""
