from noticiario.functions import dates, text, urls

__all__ = ["dates", "text", "urls"]
