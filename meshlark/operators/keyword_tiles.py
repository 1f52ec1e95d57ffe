"""Sums of term weights for many queries over many documents, a tile of both at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Numbers in the rows of weights of a block, and documents, terms of documents and queries that meet at a time.
CELLS, DOCS, POSTINGS, TILE = 16_000_000, 8192, 3_000_000, 128
#: The most frequent terms, whose weights are bounded first, and the share of the documents from which on a term is added as a row.
FREQUENT, SHARE = 64, 1 / 48
#: Digits of a score.
DIGITS = 6


def blocks(batches: Iterable[pa.RecordBatch], rows: int, column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to blocks of at most ``rows`` rows, which end when their lists in ``column`` pass ``POSTINGS``.

    The first block is an eighth of that: it fills the lists, which costs most a row.
    """
    held, many, size, most, rows = [], 0, 0, rows, max(1, rows // 8)
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows - many)
            held.append(part)
            at, many, size = at + part.num_rows, many + part.num_rows, size + len(part.column(column).flatten())
            if many == rows or size >= POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, many, size, rows = [], 0, 0, most
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs that begin at ``first``, and the number of the run of each."""
    at = np.repeat(first - np.cumsum(count) + count, count)
    at += np.arange(len(at))
    return at, np.repeat(np.arange(len(count)), count)


def _sums(at: np.ndarray, weights: np.ndarray, many: int) -> np.ndarray:
    """The sum of the weights at each of ``many`` places; counts where there is nothing to add would be integers."""
    return np.bincount(at, weights, many).astype(float, copy=False)


class _Terms:
    """The terms of one kind that each query asks for."""

    def __init__(self, query: np.ndarray, term: np.ndarray, many: int):
        self.query, self.term = query.astype(np.int32), term.astype(np.int32)
        self.first = np.searchsorted(query, np.arange(many + 1))

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of some queries, and the place of the query of each."""
        at, run = _ragged(self.first[queries], self.first[queries + 1] - self.first[queries])
        return self.term[at], run


class Asking:
    """Best documents of many queries, found block by block of documents.

    ``terms``: the numbers of the queries' terms, one query after the other; query i has those
    from ``ends[i]`` to ``ends[i + 1]``. ``df``: in how many of ``n`` documents each term occurs.

    Weights are rounded up to small integers, so that sums of these are bounds of the scores:
    terms of many documents are added row by row, rare ones cell by cell, and the most frequent
    ones count with their greatest weight. Where this leaves many documents of a query, the
    most frequent terms are added row by row, too. What may still reach a list is added up in
    double precision. A query whose terms in a block can't reach its list together leaves out
    the block.
    """

    def __init__(self, terms: np.ndarray, ends: np.ndarray, df: np.ndarray, n: int, top: int):
        self.many, self.top = len(ends) - 1, top
        query = np.repeat(np.arange(self.many), np.diff(ends))
        query, terms = query[df[terms] > 0], terms[df[terms] > 0]
        known, term = np.unique(terms, return_inverse=True)
        self.place = np.full(len(df), -1, np.int32)
        self.place[known] = np.arange(len(known))
        shared = df[known] * np.bincount(term, minlength=len(known))
        kind = np.where(df[known] > n * SHARE, 1, 2)
        kind[np.argsort(-shared, kind="stable")[:FREQUENT]] = 0
        self.row = np.where(kind < 2, np.cumsum(kind < 2) - 1, -1)  # of the terms that have one
        self.rows = int(np.count_nonzero(kind < 2))
        self.often, self.some, self.rare = (_Terms(query[kind[term] == k], term[kind[term] == k], self.many) for k in range(3))
        self.last, self.added = (self._rows_of(x) for x in (self.often, self.some))
        self.docs = int(min(DOCS, max(512, CELLS // max(1, self.rows)))) // 8 * 8
        self.asked = np.bincount(query, minlength=self.many)
        self.whole = np.uint16 if self.many == 0 or self.asked.max() < 30_000 else np.uint32

    def _rows_of(self, terms: _Terms) -> list[list[int]]:
        rows, first = self.row[terms.term].tolist(), terms.first.tolist()
        return [rows[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def lists(self) -> np.ndarray:
        """The best scores of each query so far, the least first."""
        return np.full((self.many, self.top), -np.inf)

    def found(self, best: np.ndarray, docs: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, documents and scores that are among the ``best`` so far, of a block of ``docs`` documents.

        ``best`` takes up the scores. ``weights``: those of ``terms`` in the documents numbered ``rows``; a document has a term once.
        """
        terms = self.place[terms]
        known = np.flatnonzero(terms >= 0)
        known = known[np.argsort(terms[known].astype(np.int64) * docs + rows[known])]
        if not len(known):
            return
        rows, terms, weights = rows[known], terms[known], weights[known]
        count = np.bincount(terms, minlength=len(self.row))
        first, high, there = np.cumsum(count) - count, np.zeros(len(count)), np.flatnonzero(count)
        high[there] = np.maximum.reduceat(weights, first[there])
        const, rest = _sums(self.often.query, high[self.often.term], self.many), np.zeros(self.many)
        for x in (self.some, self.rare):
            rest += _sums(x.query, high[x.term], self.many)
        slack = 10.0**-DIGITS + (const + rest) * 1e-9  # of rounding, and of sums in any order
        least = best[:, 0]
        kept = np.flatnonzero((const + rest > 0) & (const + rest >= least - slack))
        step = max((const + rest).max(), 1e-9) / (30_000 if self.whole is np.uint16 else 1 << 30)
        whole = np.ceil(weights / step).astype(self.whole)
        row, place_of = np.zeros((self.rows, docs), self.whole), np.full((self.rows, docs), -1, np.int32)
        dense = np.flatnonzero(self.row[terms] >= 0)
        row[self.row[terms[dense]], rows[dense]] = whole[dense]
        place_of[self.row[terms[dense]], rows[dense]] = dense
        weights = np.append(weights, 0.0)  # at -1, where a document lacks a term
        row_of, tile, marks = list(row), np.empty((TILE, docs), self.whole), np.empty((TILE, docs), bool)
        for a in range(0, len(kept), TILE):
            q = kept[a : a + TILE]
            sums, mask = tile[: len(q)], marks[: len(q)]
            sums.fill(0)
            for mine, x in zip(sums, q.tolist(), strict=True):
                for m in self.added[x]:
                    np.add(mine, row_of[m], mine)
            t, i = self.rare.of(q)
            place = _ragged(first[t], count[t])[0]
            cell = np.repeat(i * docs, count[t])
            cell += rows[place]
            np.add.at(sums.reshape(-1), cell, whole[place])
            np.greater_equal(sums, self._needed((least - slack - const)[q] / step), out=mask)
            spots = mask.view(np.uint64) if docs % 8 == 0 else mask  # eight documents in one step
            crowded = np.flatnonzero(np.count_nonzero(spots, axis=1) > 2 * self.top + 8)
            if len(crowded):
                for x in crowded.tolist():
                    mine = sums[x]
                    for m in self.last[q[x]]:
                        np.add(mine, row_of[m], mine)
                mask[crowded] = self._near(q[crowded], sums[crowded], step, least, slack)
            flat = np.flatnonzero(mask)
            if not len(flat):
                continue
            i, d = np.divmod(flat, docs)
            exact = self._exact(self.often, q[i], d, weights, place_of)
            added = np.zeros(len(q), bool)
            added[crowded] = True
            near = np.where(added[i], 0.0, exact) + sums.reshape(-1)[flat] * step >= (least - slack)[q[i]]
            flat, i, d, exact = flat[near], i[near], d[near], exact[near]
            if not len(flat):
                continue
            mask.fill(False)
            mask.reshape(-1)[flat] = True
            hit = np.flatnonzero(mask.reshape(-1)[cell])
            exact += _sums(np.searchsorted(flat, cell[hit]), weights[place[hit]], len(flat))
            exact += self._exact(self.some, q[i], d, weights, place_of)
            score = np.floor(exact * 10.0**DIGITS + 0.5) / 10.0**DIGITS
            fit = (exact > 0) & (score >= least[q[i]])
            i, d, score = i[fit], d[fit], score[fit]
            self._take_up(best, q, i, score)
            yield q[i], d, score

    def _exact(self, terms: _Terms, q: np.ndarray, d: np.ndarray, weights: np.ndarray, place_of: np.ndarray) -> np.ndarray:
        """The weights of terms with rows, for pairs of queries and documents."""
        out = np.zeros(len(q))
        for b in (slice(x, x + 65_536) for x in range(0, len(q), 65_536)):
            t, run = terms.of(q[b])
            out[b] = _sums(run, weights[place_of[self.row[t], d[b][run]]], len(q[b]))
        return out

    def _needed(self, steps: np.ndarray) -> np.ndarray:
        """Bounds as a column of integers."""
        return np.clip(np.floor(steps), 0, np.iinfo(self.whole).max).astype(self.whole)[:, None]

    def _near(self, q: np.ndarray, sums: np.ndarray, step: float, least: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Where the sums over all terms may reach a list; ``top`` documents of the block make one where there is none."""
        reach, docs = (least - slack)[q] / step, sums.shape[1]
        short = np.flatnonzero(reach == -np.inf) if docs > self.top else ()
        if len(short):
            last = np.partition(sums[short], docs - self.top, axis=1)[:, docs - self.top]
            reach[short] = last - (self.asked[q[short]] + 1.0) - 2 * slack[q[short]] / step
        return sums >= np.maximum(self._needed(reach), 1)  # over zero: only documents with a term count

    def _take_up(self, best: np.ndarray, q: np.ndarray, i: np.ndarray, score: np.ndarray) -> None:
        rows, first, at = np.unique(i, return_index=True, return_inverse=True)
        if not len(rows):
            return
        place = np.arange(len(i)) - first[at]
        width = int(place.max()) + 1
        both = np.full((len(rows), self.top + width), -np.inf)
        both[:, : self.top] = best[q[rows]]
        both[at, self.top + place] = score
        best[q[rows]] = np.partition(both, width, axis=1)[:, width:]
