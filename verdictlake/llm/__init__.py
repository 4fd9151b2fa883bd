"""Operators of a training-data pipeline: mixing, near duplicates, WARC,
packing, sharding, token files, exact search, language models, quality and
toxicity.  Nothing outside this subpackage imports it."""
