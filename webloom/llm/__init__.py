"""Training-data operators: scoring, filtering, de-duplication, decontamination and tokenization of text tables."""
