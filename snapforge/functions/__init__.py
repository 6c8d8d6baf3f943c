"""Column expressions: names, masks, cell codecs, digests."""
