"""Training-data operators: texts in, decisions about texts out."""
