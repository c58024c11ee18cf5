"""Errors raised where rows, queries and filters come in."""

from __future__ import annotations


class VecstrataError(Exception):
    """Base of all errors of this library."""


class ScanError(VecstrataError):
    """A query or filter doesn't fit the corpus."""


class FilterLengthError(ScanError):
    def __init__(self, filter_len: int, rows: int):
        super().__init__(f"the filter was made for {filter_len} rows; the corpus has {rows}")
        self.filter_len, self.rows = filter_len, rows


class QueryDimError(ScanError):
    def __init__(self, query_dim: int, corpus_dim: int):
        super().__init__(f"queries have {query_dim} dimensions; the corpus has {corpus_dim}")
        self.query_dim, self.corpus_dim = query_dim, corpus_dim


class UnknownIdError(ScanError):
    """A candidate pool names an id that the corpus lacks, or names one twice."""


class StorageError(VecstrataError):
    """Rows have no consistent geometry."""


class ZeroDimError(StorageError):
    def __init__(self):
        super().__init__("vectors need one dimension or more")


class RaggedError(StorageError):
    def __init__(self, found: int, expected: int):
        super().__init__(f"a row holds {found} values; expected {expected}")


class StrideError(StorageError):
    def __init__(self, found: int, expected: int):
        super().__init__(f"{found} bytes of sign bits are too few for a row; expected {expected}")


class ScaleCountError(StorageError):
    def __init__(self, scales: int, rows: int):
        super().__init__(f"column scale: {rows - scales} of {rows} rows have none")


class TooManyRowsError(StorageError):
    def __init__(self, rows: int):
        super().__init__(f"{rows} rows don't fit 32-bit ids, which u32_ids asks for")


class SourceError(VecstrataError):
    """A file of vectors can't be read."""
