"""Text-corpus analytics on PySpark: cleaning, pairing, filtering, splitting and measuring corpora as DataFrame plans."""
