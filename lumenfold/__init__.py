"""lumenfold: a PySpark library for detector time streams, gridded sky data and text corpora."""
