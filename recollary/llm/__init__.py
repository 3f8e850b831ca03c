"""Operators for preparing training data: fusion, vector search, splitting, language, privacy,
packing, leakage and encoding repair. Nothing outside this subpackage imports it."""
