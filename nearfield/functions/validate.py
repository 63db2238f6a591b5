"""Checks of requests, configurations and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("L2", "InnerProduct", "Cosine")
MAX_TOPK, MAX_DIMENSION, DEFAULT_NPROBE, DEFAULT_NBITS = 1000, 65536, 8, 8
#: Default lists of a new index: the root of a million vectors, at most 4096.
DEFAULT_NLIST = min(4096, int(1_000_000**0.5))


class InvalidArgument(ValueError):
    """A request that cannot be served as it is."""


class NotFound(LookupError):
    """An index or epoch that does not exist."""


def metric_of(name: str | None) -> str:
    """Blank means L2; an unknown name is an error."""
    if not name:
        return "L2"
    if name not in METRICS:
        raise InvalidArgument(f"unknown metric {name!r}")
    return name


def search_request(index: str, topk: int, nprobe: int, n_queries: int) -> int:
    """Checks a request; the nprobe to use."""
    if not index:
        raise InvalidArgument("index name is empty")
    if not n_queries:
        raise InvalidArgument("no queries")
    if not 1 <= topk <= MAX_TOPK:
        raise InvalidArgument(f"topk must be in 1..{MAX_TOPK}")
    return nprobe if nprobe > 0 else DEFAULT_NPROBE


def index_config(name: str, dimension: int, nlist: int = 0, m: int = 0, nbits: int = 0) -> tuple[int, int]:
    """Checks an index; (nlist, nbits) with their defaults."""
    if not name:
        raise InvalidArgument("index name is empty")
    if not 1 <= dimension <= MAX_DIMENSION:
        raise InvalidArgument(f"dimension must be in 1..{MAX_DIMENSION}")
    if m and dimension % m:
        raise InvalidArgument("dimension must be a multiple of m")
    return nlist if nlist > 0 else DEFAULT_NLIST, nbits if nbits > 0 else DEFAULT_NBITS


def is_valid_vector(v: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and only finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


def mismatched(vectors: DataFrame, dimension: int) -> DataFrame:
    """The rows that ingest rejects."""
    return vectors.filter(~is_valid_vector(F.col("vector"), dimension))
