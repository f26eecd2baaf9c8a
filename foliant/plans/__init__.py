"""Operations on documents by name: one request, one DataFrame."""
