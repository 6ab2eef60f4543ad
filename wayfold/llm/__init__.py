"""Training-data operators: tokenisation, quality, language, licences, near-duplicates and decontamination.

Nothing outside this subpackage imports it.
"""
