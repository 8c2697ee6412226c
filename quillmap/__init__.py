"""Corpus maps and project logs as Spark DataFrames.

Every public function takes and returns DataFrames (or builds Columns); nothing
here collects rows to the driver.
"""
