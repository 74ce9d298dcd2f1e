"""Training-data operators (quality, dedup, decontamination, archives, tokens); nothing else in the library imports this."""
