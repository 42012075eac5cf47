"""Operators for text corpora: survivors, look-alikes, name links, near copies, vectors, tokens, packing, spam."""
