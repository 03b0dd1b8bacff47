"""Evaluation items that leak into training documents (problem 9).

A BM25 inverted index of the items is queried with every passage of ``SPAN`` consecutive words of every document. For each word it has
the items that hold it, with their weights, and the blocks of items, with the highest weight in each. As in block-max
WAND, a passage is left as soon as the bounds of its words cannot reach the threshold: first against the whole index; then
only the blocks of its pivot, the word that the fewest blocks hold, are looked up, each against its bound; then the items of the
blocks that are left. The threshold of an item is the least score that any ``SPAN`` consecutive words of it have, and
scores only add up, so no leak is lost. What is retrieved is verified exactly: ``SPAN`` consecutive words of the
item's own text, and how many of its words and of its answer's the document holds.

Postings are sorted arrays, looked up for all passages of a document at once. Executors get the items' words, at most ``PART``
items at a time, and build the index themselves, each worker once: 20,000 items of 60 words take about 100 MB there. More items
take more passes over the documents, so memory is bounded however many there are.

Defined results
* Words are runs of letters and digits after NFKC, HTML unescaping, removal of invisible characters and lower-casing.
* A closing sentence that at least ``CLOSING`` items of the whole table have in common is no part of their own text.
* Items of fewer than ``SPAN`` words cannot leak. Null and blank texts and an empty table give no rows.
* Repeated documents each count; a document and an item are one row. Long documents are searched whole.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.runtime import map_batches, table

SPAN, CLOSING, PART = 12, 12, 20_000
K1, B, BLOCK = 1.2, 0.75, 16

_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def normalise(text: str) -> str:
    if "&" in text:
        for _ in range(2):
            text = _ENTITY.sub(lambda m: html.unescape(m.group(0)), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        text = _INVISIBLE.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    return _WORD.findall(normalise(text)) if text else []


def _closing(text: str | None) -> str:
    sentences = _SENTENCE.split(text.strip()) if text else []
    return " ".join(words(sentences[-1])) if len(sentences) > 1 else ""


def closings(items: DataFrame, least: int = CLOSING) -> set[str]:
    """The closing sentences, in words, that at least ``least`` items have in common: a small part of the items."""

    def last(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_closing(t) for t in batch.column(0).to_pylist()], pa.string())], names=["closing"])

    counted = map_batches(items.select("text"), last, "closing string").where("closing <> ''").groupBy("closing").count()
    return {r.closing for r in counted.where(F.col("count") >= least).select("closing").collect()}


def own_texts(items: list[tuple[int, str | None, str | None]], shared: set[str]) -> list[tuple[int, list[str], list[str]]]:
    """(item, words of its own text, words of its answer): the text without a closing sentence that is in ``shared``."""
    out = []
    for i, text, answer in items:
        own = _SENTENCE.split(text.strip()) if text else []
        out.append((i, words(" ".join(own[:-1] if _closing(text) in shared else own)), words(answer)))
    return out


class Postings:
    """(word, holder, weight) in order, found by word and holder."""

    def __init__(self, word: np.ndarray, holder: np.ndarray, weight: np.ndarray, n_words: int, n_holders: int):
        key = word.astype(np.int64) * n_holders + holder
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.n, self.key = n_holders, key[head]
        self.weight = np.maximum.reduceat(weight, head) if len(key) else weight
        self.start = np.searchsorted(self.key, np.arange(n_words + 2, dtype=np.int64) * n_holders)
        self.counts = np.diff(self.start)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where all postings of the words are, word by word."""
        n = self.counts[words]
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[words], n)

    def holders(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words, holder) of all their postings."""
        return np.repeat(np.arange(len(words)), self.counts[words]), self.key[self.places(words)] % self.n

    def sums(self, passages: np.ndarray, holders: np.ndarray) -> np.ndarray:
        """The weights of each passage's words at its holder, added up."""
        want = passages.astype(np.int64) * self.n + holders[:, None]
        at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        return np.where(self.key[at] == want, self.weight[at], np.float32(0)).sum(1)


class Index:
    """Postings of items and of blocks of them, thresholds, and the places of all spans to verify."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], span: int = SPAN):
        items = [x for x in items if len(x[1]) >= span]
        self.span, self.ids = span, [i for i, _, _ in items]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws, _ in items for w in ws}))}
        n, v = len(items), len(self.vocabulary)
        self.unknown, self.answers = v, [set(a) for _, _, a in items]
        mean = np.mean([len(ws) for _, ws, _ in items]) if items else 1.0
        self.coded = np.array([self.vocabulary[w] for _, ws, _ in items for w in ws], np.int32)
        ends = np.cumsum([len(ws) for _, ws, _ in items]).astype(np.int64)
        bag = [Counter(self.coded[a:b].tolist()) for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends)] if items else []
        word = np.array([w for c in bag for w in c], np.int64)
        holder = np.repeat(np.arange(n), [len(c) for c in bag]) if items else np.zeros(0, np.int64)
        tf = np.array([x for c in bag for x in c.values()], np.float64)
        df = np.bincount(word, minlength=v) if v else np.zeros(0)
        norm = K1 * (1 - B + B * np.array([len(ws) for _, ws, _ in items]) / mean) if items else np.zeros(0)
        weight = (np.log(1 + (n - df[word] + 0.5) / (df[word] + 0.5)) * tf * (K1 + 1) / (tf + norm[holder])).astype(np.float32) if items else np.zeros(0, np.float32)
        self.items = Postings(word, holder, weight, v, max(1, n))
        self.blocks = Postings(word, holder // BLOCK, weight, v, max(1, -(-n // BLOCK)))
        self.word_max = np.zeros(v + 1, np.float32)
        np.maximum.at(self.word_max, word, weight)
        # every span of every item: its place, its hash together with the item, and its score
        item = np.repeat(np.arange(n), np.maximum(0, np.array([len(ws) - span + 1 for _, ws, _ in items], np.int64))) if items else np.zeros(0, np.int64)
        size = np.array([len(ws) - span + 1 for _, ws, _ in items], np.int64)
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if items else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size) if items else np.zeros(0, np.int64)
        self.threshold = np.full(n, np.inf, np.float32)
        for a in range(0, len(place), 65_536):
            at = place[a : a + 65_536]
            scores = self.items.sums(self._distinct(self.coded[at[:, None] + np.arange(span)]), item[a : a + 65_536])
            np.minimum.at(self.threshold, item[a : a + 65_536], scores)
        self.threshold -= 1e-3
        self.block_threshold = np.minimum.reduceat(self.threshold, np.arange(0, n, BLOCK)) if n else np.zeros(0, np.float32)
        self.least = float(self.threshold.min()) if n else np.inf
        named = self._hash(self.coded[place[:, None] + np.arange(span)], item) if n else np.zeros(0, np.uint64)
        order = np.argsort(named, kind="stable")
        self.named, self.place = named[order], place[order]

    def _distinct(self, passages: np.ndarray) -> np.ndarray:
        """The passages' words, each once; in place of the others the unknown word, which nothing holds."""
        passages = np.sort(passages, 1)
        first = np.concatenate([np.ones((len(passages), 1), bool), passages[:, 1:] != passages[:, :-1]], 1)
        return np.where(first, passages, self.unknown)

    @staticmethod
    def _hash(passages: np.ndarray, item: np.ndarray) -> np.ndarray:
        h = item.astype(np.uint64) + np.uint64(1)
        for j in range(passages.shape[1]):
            h = (h ^ (passages[:, j].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h

    def encode(self, text: str) -> np.ndarray:
        get, unknown = self.vocabulary.get, self.unknown
        return np.array([get(w, unknown) for w in _WORD.findall(normalise(text))], np.int32)

    def retrieve(self, coded: np.ndarray, most: int = 1024) -> list[tuple[int, int]]:
        """(start, item) of the passages of ``span`` consecutive words that reach an item's threshold, looked up ``most`` passages at a time."""
        span, n = self.span, len(coded) - self.span + 1
        if n < 1 or not self.ids:
            return []
        # a passage with a word that no item has cannot be verified; repeated words count each time, which only raises the bound
        strange = np.concatenate([[0], np.cumsum(coded == self.unknown)])
        starts = np.flatnonzero(strange[span:] == strange[:-span])
        if not len(starts):
            return []
        total = np.concatenate([[0.0], np.cumsum(self.word_max[coded].astype(np.float64))])
        starts = starts[total[starts + span] - total[starts] >= self.least - 1e-3]
        out = []
        for a in range(0, len(starts), most):
            out += self._look_up(coded, starts[a : a + most])
        return out

    def _look_up(self, coded: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        at = starts[:, None] + np.arange(self.span)
        # the block postings of the words that occur here, as a table that is read by place
        here, local = np.unique(coded[at], return_inverse=True)
        local = local.reshape(at.shape)
        word, holder = self.blocks.holders(here)
        table = np.zeros((len(here), self.blocks.n), np.float32)
        table[word, holder] = self.blocks.weight[self.blocks.places(here)]
        pivot = local[np.arange(len(local)), np.argmin(self.blocks.counts[here][local], 1)]
        n = self.blocks.counts[here]
        first = np.cumsum(n) - n
        which = np.repeat(np.arange(len(starts)), n[pivot])
        block = holder[np.arange(len(which)) - np.repeat(np.cumsum(n[pivot]) - n[pivot], n[pivot]) + np.repeat(first[pivot], n[pivot])]
        # repeated words count each time, which only raises the bound
        bound = table[local[which, 0], block]
        for j in range(1, self.span):
            bound += table[local[which, j], block]
        near = bound >= self.block_threshold[block]
        which, block = which[near], block[near]
        item = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        which = np.repeat(which, BLOCK)[item < len(self.ids)]
        item = item[item < len(self.ids)]
        good = self.items.sums(self._distinct(coded[at])[which], item) >= self.threshold[item]
        return list(zip(starts[which[good]].tolist(), item[good].tolist()))

    def held(self, items: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """Whether each item has exactly the words of its passage one after the other."""
        h = self._hash(passages, items)
        low, high = np.searchsorted(self.named, h), np.searchsorted(self.named, h, "right")
        out = np.zeros(len(h), bool)
        while (open := np.flatnonzero((low < high) & ~out)).size:
            at = self.place[low[open]]
            out[open] = (self.coded[at[:, None] + np.arange(self.span)] == passages[open]).all(1)
            low[open] += 1
        return out

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, words of its spans found, words of its answer found) of each item that leaks into the text."""
        if not text:
            return []
        coded = self.encode(text)
        found = np.array(self.retrieve(coded), np.int64).reshape(-1, 2)
        if not len(found):
            return []
        shared: dict[int, set[int]] = {}
        for start, item in found[self.held(found[:, 1], coded[found[:, :1] + np.arange(self.span)])].tolist():
            shared.setdefault(item, set()).update(range(start, start + self.span))
        if not shared:
            return []
        said = set(words(text))
        return [(self.ids[k], len(places), len(self.answers[k] & said)) for k, places in sorted(shared.items())]


def leaked(documents: DataFrame, items: DataFrame, span: int = SPAN, closing: int = CLOSING) -> DataFrame:
    """(doc_id, item_id, shared_words, answer_words) of every document and item that share ``span`` consecutive words."""
    shared, parts = closings(items, closing), max(1, -(-items.count() // PART))
    found = [_leaked(documents, items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) if parts > 1 else items, shared, span) for p in range(parts)]
    return reduce(DataFrame.unionByName, found)


#: The index that this worker has built last, by what it is made of.
_built: dict[str, Index] = {}


def index_of(name: str, held: list, span: int) -> Index:
    if name not in _built:
        _built.clear()
        _built[name] = Index(held, span)
    return _built[name]


def _leaked(documents: DataFrame, items: DataFrame, shared: set[str], span: int) -> DataFrame:
    held = own_texts([tuple(r) for r in items.select("item_id", "text", "answer").orderBy("item_id").collect()], shared)
    name = hashlib.sha256(repr((span, held)).encode("utf-8", "surrogatepass")).hexdigest()

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = index_of(name, held, span)
        found = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in index.leaks(t)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, types)], names=["doc_id", "item_id", "shared_words", "answer_words"])

    return map_batches(documents.select("doc_id", "text").where("text is not null"), find, "doc_id long, item_id long, shared_words int, answer_words int")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leaked(table(spark, base, "documents"), table(spark, base, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, base: str) -> DataFrame:
    return leaked(table(spark, base, "documents"), table(spark, base, "eval_items"))
