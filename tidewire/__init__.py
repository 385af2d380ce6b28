"""Article ingestion and vector search expressed as Spark jobs.

``functions``  column expressions (text, dates, ids, vectors)
``sources``    feed schemas and readers, the Parquet vector store
``operators``  DataFrame -> DataFrame steps (dedup, chunking, embedding, search)
``streaming``  the same steps run over a Structured Streaming source
``plans``      registered queries and their SQL counterparts
"""
