"""Sources: corpora, file trees, symbol indexes, repositories."""
