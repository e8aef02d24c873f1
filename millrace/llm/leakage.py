"""Evaluation texts leaking into documents: BM25 over an inverted index of test items, block-max WAND.

Every document is cut into passages that overlap by ``run`` words, so each run of ``run`` consecutive words
lies whole in a passage. Items are cut likewise into sections, the entries of the
index. A passage is a BM25 query. A section is retrieved when its score reaches the smallest score that
any run of its own words can have; a passage holding such a run scores at least that, so nothing is lost.
Postings are kept in blocks of sections with the block's largest contribution; blocks whose bound stays
below the threshold are never scored. Retrieved passages are verified word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75


class ItemIndex:
    """BM25 postings of the items of one shard; weights are divided by the section's own threshold, so 1 is the bar.

    All tables are sparse: one posting for each word and block of sections that hold it, and one hash for each
    run of words; they grow in proportion to the words of the items.
    """

    def __init__(self, items: list[tuple[int, list[str]]], run: int, block: int) -> None:
        self.run, self.block, self.stride, self.width = run, block, run, 2 * run
        items = [(i, w) for i, w in items if len(w) >= run]
        self.vocab = {w: k for k, w in enumerate(sorted({x for _, ws in items for x in ws}))}
        self.words = np.fromiter((self.vocab[x] for _, ws in items for x in ws), dtype=np.int32)
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        lens = np.array([len(w) for _, w in items], dtype=np.int64)
        self.blocks = 0
        if not len(items):
            return
        start = np.append(0, np.cumsum(lens))
        self._post(start, lens)
        self._hash_runs(start, lens)

    def _hash_runs(self, start: np.ndarray, lens: np.ndarray) -> None:
        """One hash for each run of words of an item, sorted, with its item and the place of the run."""
        rng = np.random.default_rng(7)
        self.mul = rng.integers(1, 2**63, self.run, dtype=np.uint64) | np.uint64(1)
        count = lens - self.run + 1
        owner = np.repeat(np.arange(len(lens)), count)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count)
        hashes = self._hashes(self.words)[at]
        order = np.argsort(hashes, kind="stable")
        self.run_hash, self.run_item, self.run_at = hashes[order], owner[order].astype(np.int32), at[order].astype(np.int64)

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        """The hash of the run of words that begins at each place."""
        n = len(words) - self.run + 1
        wide, out = words.astype(np.uint64), np.zeros(max(0, n), dtype=np.uint64)
        for k in range(self.run if n > 0 else 0):
            out += (wide[k : k + n] + np.uint64(1)) * self.mul[k]
        return out

    def _post(self, start: np.ndarray, lens: np.ndarray) -> None:
        """The postings of the sections: 2 * run - 1 words from every run-th word on, so each run of an item lies whole in one."""
        run, none = self.run, len(self.vocab)
        count = -(-(lens - run + 1) // run)
        owner = np.repeat(np.arange(len(lens)), count)
        begin = start[owner] + (np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count)) * run
        size = np.minimum(2 * run - 1, start[owner + 1] - begin)
        grid = begin[:, None] + np.arange(2 * run - 1)
        inside = np.arange(2 * run - 1) < size[:, None]
        text = np.where(inside, self.words[np.minimum(grid, len(self.words) - 1)], none)
        n, avg = len(text), float(size.mean())
        ordered = np.argsort(text, axis=1, kind="stable")
        w = np.take_along_axis(text, ordered, axis=1)
        new = np.ones_like(w, dtype=bool)
        new[:, 1:] = w[:, 1:] != w[:, :-1]
        new &= w < none
        df = np.bincount(w[new], minlength=none)
        # The frequency of a word in its section, at each of its places.
        group = np.cumsum(new.ravel()) - 1
        tf = np.bincount(group, weights=(w < none).ravel(), minlength=group[-1] + 1)[group].reshape(w.shape)
        idf = np.append(np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0)
        weight = idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg)[:, None])
        placed = np.empty_like(weight)
        np.put_along_axis(placed, ordered, weight, axis=1)
        least = np.full(n, np.inf)
        for s in range(run):
            span = text[:, s : s + run]
            by = np.argsort(span, axis=1, kind="stable")
            sp = np.take_along_axis(span, by, axis=1)
            first = np.ones_like(sp, dtype=bool)
            first[:, 1:] = sp[:, 1:] != sp[:, :-1]
            total = (np.take_along_axis(placed[:, s : s + run], by, axis=1) * first).sum(axis=1)
            least = np.where(s + run <= size, np.minimum(least, total), least)
        # Sections that share rare words stand together: blocks then have tighter bounds.
        rarest = np.where(new, df[np.minimum(w, none - 1)].astype(np.int64) * (none + 1) + w, np.iinfo(np.int64).max).min(axis=1)
        place = np.empty(n, dtype=np.int64)
        place[np.lexsort((begin, rarest))] = np.arange(n)
        self.blocks = -(-n // self.block)
        sec, col = np.nonzero(new)
        key, slot = w[sec, col].astype(np.int64) * self.blocks + place[sec] // self.block, place[sec] % self.block
        held = np.unique(key)
        weights = np.zeros((len(held), self.block), dtype=np.float32)
        weights[np.searchsorted(held, key), slot] = weight[sec, col] / least[sec]
        # Words are numbered by the length of their postings, longest first: a passage leaves out the longest
        # ones as long as together they can't add more than the slack.
        term, at = held // self.blocks, held % self.blocks
        order = np.argsort(-np.bincount(term, minlength=none), kind="stable")
        number = np.empty(none, dtype=np.int64)
        number[order] = np.arange(none)
        self.vocab = {x: int(number[k]) for x, k in self.vocab.items()}
        self.words = number[self.words].astype(np.int32)
        key = number[term] * self.blocks + at
        by = np.argsort(key)
        self.posting_key, self.weights = key[by], weights[by]
        self.posting_block, self.posting_bound = (self.posting_key % self.blocks).astype(np.int32), self.weights.max(axis=1)
        self.start = np.searchsorted(self.posting_key, np.arange(none + 1) * self.blocks)
        self.slack, self.most = 0.3, np.append(np.maximum.reduceat(self.posting_bound, self.start[:-1]), 0)

    def retrieve(self, words: np.ndarray, doc_start: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document index, begin, end) of passages that retrieve a section; words are the ids of all documents in a row, -1 outside the vocabulary."""
        if not self.blocks:
            return
        n, stride, width, none = len(words), self.stride, self.width, len(self.vocab)
        lens = np.diff(np.append(doc_start, n))
        count = np.maximum(1, -(-(lens - self.run) // stride))
        doc = np.repeat(np.arange(len(doc_start)), count)
        first = np.repeat(np.append(0, np.cumsum(count)[:-1]), count)
        begin = doc_start[doc] + (np.arange(len(doc)) - first) * stride
        size = np.minimum(width, doc_start[doc] + lens[doc] - begin)
        for s in range(0, len(doc), 4_000):
            d, lo, ln = doc[s : s + 4_000], begin[s : s + 4_000], size[s : s + 4_000]
            grid = lo[:, None] + np.arange(width)[None, :]
            w = np.where(np.arange(width)[None, :] < ln[:, None], words[np.minimum(grid, n - 1)], -1)
            enough = (w >= 0).sum(axis=1) >= self.run
            d, lo, ln, w = d[enough], lo[enough], ln[enough], np.sort(w[enough], axis=1)
            if not len(d):
                continue
            w[:, 1:][w[:, 1:] == w[:, :-1]] = -1
            w[w < 0] = none
            so_far = np.cumsum(self.most[w], axis=1)
            left_out = np.where(so_far <= self.slack, so_far, 0).max(axis=1)
            used = (w < none) & (so_far > self.slack)
            touched = np.where(used, (self.start[np.minimum(w, none - 1) + 1] - self.start[np.minimum(w, none - 1)]), 0).sum(axis=1)
            # Passages are taken together as long as their postings and counters stay within a fixed memory.
            part = np.cumsum(np.maximum(touched, 1)) // 2_000_000
            for r in np.split(np.arange(len(d)), np.flatnonzero(np.diff(part)) + 1):
                p, cells, bound = self._bounds(w[r], used[r])
                hot = bound + left_out[r][p] >= 1 - 1e-4
                q, b = r[p[hot]], cells[hot]
                for h in range(0, len(q), 50_000):
                    qs, bs = q[h : h + 50_000], b[h : h + 50_000]
                    hit = np.unique(qs[(self._scores(w[qs], bs) >= 1 - 1e-4).any(axis=1)])
                    yield from zip(d[hit].tolist(), lo[hit].tolist(), (lo[hit] + ln[hit]).tolist())

    def _bounds(self, w: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, block, bound) of the blocks that the used words of the passages touch."""
        p, col = np.nonzero(used)
        term = w[p, col]
        cnt = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.append(0, np.cumsum(cnt)[:-1]), cnt) + np.arange(cnt.sum())
        cell = np.repeat(p.astype(np.int64) * self.blocks, cnt) + self.posting_block[at]
        if len(w) * self.blocks <= 4_000_000:
            total = np.bincount(cell, weights=self.posting_bound[at], minlength=len(w) * self.blocks)
            cells = np.flatnonzero(total)
            return cells // self.blocks, cells % self.blocks, total[cells]
        cells, back = np.unique(cell, return_inverse=True)
        return cells // self.blocks, cells % self.blocks, np.bincount(back, weights=self.posting_bound[at], minlength=len(cells))

    def _scores(self, w: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The scores of passages (rows of distinct words) for the sections of a block each."""
        score = np.zeros((len(w), self.block), dtype=np.float32)
        for c in range(w.shape[1]):
            key = w[:, c].astype(np.int64) * self.blocks + block
            at = np.minimum(np.searchsorted(self.posting_key, key), len(self.posting_key) - 1)
            held = self.posting_key[at] == key
            score[held] += self.weights[at[held]]
        return score

    def matches(self, words: np.ndarray) -> set[int]:
        """The items of which the words have a whole run, in order."""
        h = self._hashes(words)
        lo, hi = np.searchsorted(self.run_hash, h, side="left"), np.searchsorted(self.run_hash, h, side="right")
        out: set[int] = set()
        for s in np.flatnonzero(hi > lo).tolist():
            for k in range(lo[s], hi[s]):
                at = self.run_at[k]
                if np.array_equal(self.words[at : at + self.run], words[s : s + self.run]):
                    out.add(int(self.ids[self.run_item[k]]))
        return out


_held: dict[str, ItemIndex] = {}


def _index(name: str, items: list[tuple[int, str]], run: int, block: int) -> ItemIndex:
    """The index of a shard; a worker process keeps the last one for its next task."""
    if name not in _held:
        _held.clear()
        _held[name] = ItemIndex([(i, WORD.findall(q.lower())) for i, q in items], run, block)
    return _held[name]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "query", run: int = 15, block: int = 4, shard_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id), distinct: the document has ``run`` consecutive words of the item in the same order.

    Words are lower-cased maximal runs of letters and digits. Null ids or texts and items shorter than
    ``run`` words never match; a repeated row counts once; empty tables give no rows. The items are cut
    into shards of at most ``shard_chars`` characters (one item at least); each task gets the shards one
    after the other, so what is sent at once has a fixed bound whatever the number of items.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    tests = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(query).alias("q")).where("i is not null and q is not null").distinct()
    out, shard, chars = None, [], 0

    def search(shard: list[tuple[int, str]]) -> DataFrame:
        share = spark.sparkContext.broadcast(shard)
        name = hashlib.sha256(repr((shard, run, block)).encode()).hexdigest()

        def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(name, share.value, run, block)
            get = index.vocab.get
            for pdf in batches:
                for s in range(0, len(pdf), 1000):
                    ids, texts = pdf["doc_id"].to_numpy()[s : s + 1000], pdf["text"].iloc[s : s + 1000]
                    parts = [np.array([get(w, -1) for w in WORD.findall(x.lower())], dtype=np.int32) for x in texts]
                    lens = np.array([len(x) for x in parts])
                    keep = np.nonzero(lens >= run)[0]
                    if not len(keep):
                        continue
                    flat = np.concatenate([parts[k] for k in keep])
                    start = np.append(0, np.cumsum(lens[keep])[:-1])
                    hits = list({(ids[keep[d]], i) for d, lo, hi in index.retrieve(flat, start) for i in index.matches(flat[lo:hi])})
                    if hits:
                        yield pd.DataFrame(hits, columns=["doc_id", "item_id"])

        return src.mapInPandas(run_batches, "doc_id bigint, item_id bigint")

    for r in tests.orderBy("i", "q").toLocalIterator():
        if shard and chars + len(r.q) > shard_chars:
            out = search(shard) if out is None else out.unionByName(search(shard))
            shard, chars = [], 0
        shard.append((r.i, r.q))
        chars += len(r.q)
    last = search(shard)
    return (last if out is None else out.unionByName(last)).distinct()
