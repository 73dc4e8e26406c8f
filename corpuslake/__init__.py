"""Search and measurement of document collections over whole tables of documents and questions."""
