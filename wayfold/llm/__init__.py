"""Training-corpus operators: one module each, with the registered queries in ``queries``."""
