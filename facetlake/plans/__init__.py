"""Multi-operator plans: assembly, search, refresh, publishing."""
