from noticiario.plans import consolidate, corpus, health, listings, progress

__all__ = ["consolidate", "corpus", "health", "listings", "progress"]
