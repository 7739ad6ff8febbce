"""Document analytics for document-to-speech corpora, on Spark."""
