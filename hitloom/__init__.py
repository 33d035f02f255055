"""Hitloom: access-log and crawl analytics as Spark DataFrames."""
