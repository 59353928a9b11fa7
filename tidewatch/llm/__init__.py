"""Training-data operators: fixity, URL rules, near-duplicates, PII, search, classifiers, mixing, tokenising.

Nothing outside this subpackage imports it.
"""
