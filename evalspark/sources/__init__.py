"""Readers and writers: labelled examples, the experiment log, the prediction cache."""
