"""Operations for preparing large training corpora, as Spark jobs over a table of documents."""
