"""Operators of TESTDATA.md, each a function (spark, sf_dir) -> DataFrame over the whole tables."""
