"""Catalog, SQL, configuration, models and question answering, and the registered queries."""
