"""Operations of a training-data pipeline over a corpus of documents. Nothing else in the library imports this."""
