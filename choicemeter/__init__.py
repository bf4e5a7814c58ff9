"""Spark library for evaluating repeated categorical choices made by language models.

A model is offered a text template and a list of option cards and names one of
them.  The library plans the prompts, reads and checks the answers, fills the
templates, scores the sentences and aggregates consistency, success and
toxicity.  Every operator takes DataFrames and returns a lazy DataFrame.
"""
