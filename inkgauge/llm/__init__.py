"""Training-data operators: tokenisers, search, toxicity, packing, language model, secrets, sharding, joins, tries, sketches.

Nothing outside this subpackage imports it; of the rest of the library it uses shared tables and running totals.
"""
