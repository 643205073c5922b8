"""Exact top-k of one block of queries against batches of corpus vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUERY_TILE = 512
PAIR_CHUNK = 1 << 17


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of an Arrow list array as a float32 matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0), dtype=np.float32)
    lengths = pc.unique(pc.list_value_length(vectors))
    if vectors.null_count or len(lengths) != 1:
        raise ValueError("vectors must be present and of one length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(vectors), lengths[0].as_py())


class BlockTopK:
    """Running best ``k`` rows per query.

    A single-precision product of whole blocks finds the few rows that can still
    matter, with a slack that covers its rounding error; only those are scored
    in double precision. Scores are compared as they are. Every query has its own
    ``k`` and threshold. Memory is k rows per query plus one batch.
    """

    def __init__(
        self,
        query_ids: pa.Array,
        queries: np.ndarray,
        k: np.ndarray,
        threshold: np.ndarray,
        exclude_self: bool,
        allowed: "RequestFilters | None" = None,
    ) -> None:
        self.allowed = allowed
        self.most = int(k.max()) if len(k) else 0
        self.query_ids = query_ids
        self.queries = queries
        self.k = k
        self.threshold = threshold
        self.exclude_self = exclude_self
        self.kth = np.full(len(queries), -np.inf)
        self.best: pa.Table | None = None

    def add(self, ids: pa.Array, corpus: np.ndarray, fields: dict[str, pa.Array] | None = None) -> None:
        if len(corpus) == 0 or len(self.queries) == 0:
            return
        if corpus.shape[1] != self.queries.shape[1]:
            raise ValueError("queries and corpus differ in vector length")
        found = [
            self._candidates(start, ids, corpus, fields or {}) for start in range(0, len(self.queries), QUERY_TILE)
        ]
        parts = [t for tile in found for t in tile]
        if parts:
            self._merge(parts)

    def _candidates(
        self, start: int, ids: pa.Array, corpus: np.ndarray, fields: dict[str, pa.Array]
    ) -> list[pa.Table]:
        tile = self.queries[start : start + QUERY_TILE]
        stop = start + len(tile)
        least = np.maximum(self.kth[start:stop], self.threshold[start:stop])
        floor = least
        rough = tile @ corpus.T
        if self.allowed is not None:
            rough[~self.allowed.mask(start, stop, len(corpus), fields)] = -np.inf
        slack = self._slack(tile, corpus)
        wanted = self.most + int(self.exclude_self)
        if np.isinf(self.kth[start:stop]).any() and rough.shape[1] > wanted:
            at = rough.shape[1] - wanted
            floor = np.maximum(floor, np.partition(rough, at, axis=1)[:, at] - slack)
        q, c = np.nonzero((rough >= (floor - slack)[:, None]) & (rough > -np.inf))
        parts = []
        for lo in range(0, len(q), PAIR_CHUNK):
            qi, ci = q[lo : lo + PAIR_CHUNK], c[lo : lo + PAIR_CHUNK]
            score = np.einsum("ij,ij->i", tile[qi].astype(np.float64), corpus[ci].astype(np.float64))
            keep = score >= least[qi]
            qi, ci, score = qi[keep] + start, ci[keep], score[keep]
            part = pa.table({"q": qi, "id": ids.take(pa.array(ci)), "score": score})
            if self.exclude_self:
                part = part.filter(pc.not_equal(self.query_ids.take(part["q"]), part["id"]))
            if part.num_rows:
                parts.append(part)
        return parts

    @staticmethod
    def _slack(tile: np.ndarray, corpus: np.ndarray) -> float:
        # |rounding error| <= n u / (1 - n u) * |q| |v| for a sum of n products
        nu = tile.shape[1] * 2.0**-24
        reach = np.linalg.norm(tile, axis=1).max() * np.linalg.norm(corpus, axis=1).max()
        return float(2 * nu / (1 - nu) * reach)

    def _merge(self, parts: list[pa.Table]) -> None:
        if self.best is not None:
            parts = [self.best, *parts]
        rows = pa.concat_tables(parts)
        rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = rows["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = rank == self.k[q] - 1
        self.kth[q[last]] = rows["score"].to_numpy()[last]
        self.best = rows.filter(pa.array(rank < self.k[q])).combine_chunks()

    def result(self, schema: pa.Schema) -> pa.Table:
        if self.best is None:
            return schema.empty_table()
        place = self.best["q"].combine_chunks()
        own_k = pa.array(self.k[place.to_numpy()])
        columns = [self.query_ids.take(place), self.best["id"], self.best["score"], own_k]
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)


class RequestFilters:
    """Which corpus rows each request allows: lists of categories and severities, first and last instant.

    A list that is given but empty allows nothing; what is null allows all.
    """

    def __init__(self, requests: pa.Table) -> None:
        self.lists = {}
        for field, column in (("category", "categories"), ("severity", "severities")):
            if column in requests.column_names:
                self.lists[field] = [None if v is None else set(v) for v in requests[column].to_pylist()]
        self.after = self._instants(requests, "after", np.iinfo(np.int64).min)
        self.before = self._instants(requests, "before", np.iinfo(np.int64).max)

    @staticmethod
    def _instants(requests: pa.Table, name: str, missing: int) -> np.ndarray | None:
        if name not in requests.column_names:
            return None
        return pc.fill_null(requests[name].cast(pa.timestamp("us", "UTC")).cast(pa.int64()), missing).to_numpy()

    def mask(self, start: int, stop: int, rows: int, fields: dict[str, pa.Array]) -> np.ndarray:
        allowed = np.ones((stop - start, rows), dtype=bool)
        for field, wanted in self.lists.items():
            coded = fields[field].dictionary_encode()
            names = coded.dictionary.to_pylist()
            codes = pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False)
            for i, values in enumerate(wanted[start:stop]):
                if values is not None:
                    allowed[i] &= np.array([*(n in values for n in names), False])[codes]
        if self.after is not None or self.before is not None:
            times = fields["created_at"].cast(pa.timestamp("us", "UTC")).cast(pa.int64())
            known = ~np.asarray(times.is_null())
            at = pc.fill_null(times, 0).to_numpy(zero_copy_only=False)
            if self.after is not None:
                bound = self.after[start:stop, None]
                allowed &= (known & (at >= bound)) | (bound == np.iinfo(np.int64).min)
            if self.before is not None:
                bound = self.before[start:stop, None]
                allowed &= (known & (at <= bound)) | (bound == np.iinfo(np.int64).max)
        return allowed
