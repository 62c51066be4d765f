"""Training-data operators: language id, token output, quality, tokenisation,
toxicity, fingerprints, near-duplicates, chat formatting, decontamination.

Nothing else in the library imports this subpackage.
"""
