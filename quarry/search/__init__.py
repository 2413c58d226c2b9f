"""Search over documents and chunks: lexical tiers, phrases, vectors, fusion."""
