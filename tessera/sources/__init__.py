"""Tables, triples, mappings and service responders."""
