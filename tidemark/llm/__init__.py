"""Operators for preparing training text at scale: de-duplication, cleaning, mixing and sharding."""
