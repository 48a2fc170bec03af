"""Multi-operator reports and selections."""
