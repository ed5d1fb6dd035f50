"""Query language, expressions, pipelines and scoring, compiled to DataFrames."""
