"""Evaluation of text artifacts against labelled data, as Spark jobs."""
