"""Spark-native building, mining, quality control and evaluation of labelled image-tile datasets."""
