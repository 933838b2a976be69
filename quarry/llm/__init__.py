"""Training-data operators: near duplicates, decontamination, tokens, languages, markup, toxicity, chats and media.

Nothing else in the library imports this subpackage; it can be left out as a whole.
"""
