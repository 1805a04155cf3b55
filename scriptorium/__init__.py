"""Spark-native cleaning, segmentation, featurisation, scoring and curation of large text corpora."""
