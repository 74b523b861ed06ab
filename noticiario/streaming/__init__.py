from noticiario.streaming import arrivals

__all__ = ["arrivals"]
