from noticiario.sources import dimensions, readers, registry, writers

__all__ = ["dimensions", "readers", "registry", "writers"]
