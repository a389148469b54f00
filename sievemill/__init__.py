"""Part of sievemill."""
