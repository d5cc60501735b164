"""Part of kindred; see the README."""
