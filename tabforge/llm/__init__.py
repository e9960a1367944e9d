"""Operators for preparing training text: quality rules, decontamination, token counts, chat
formatting, URL filters, line dedup, packing, SimHash, toxicity and token files.

Each operator module has a general interface; ``queries`` holds the thin registered forms.
Nothing else in the library imports this package.
"""
