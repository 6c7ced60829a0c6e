"""Training-data operators: one module each, with the registered queries in ``queries``."""
