"""Spark-first analytics over agent memory: episodes, sessions, pages, edges and vectors as DataFrames."""
