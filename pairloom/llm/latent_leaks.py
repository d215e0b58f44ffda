"""Evaluation texts inside training texts (problem 7).

Method: latent semantic retrieval. Documents are cut into overlapping passages; a randomised SVD of
their TF-IDF matrix, computed distributedly, gives a latent space; every passage is compared by
cosine with every window of the evaluation texts (a stated query set, in blocks), and the pairs of
passage and window that are near enough are then checked one by one: by their longest common run of
words for verbatim leaks; by the longest common subsequence, and whether the item's answer stands
there too, for paraphrases.

Passages have ``2 * STEP`` words and start every ``STEP`` words, so each run of ``STEP + 1`` words
or fewer lies whole in one of them, and so do the windows of the evaluation texts. Document
frequencies count all documents. The basis of the latent space, which only steers the search, is
fitted on at most ``FIT_WORDS`` words of documents drawn by hash; every passage is searched.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.session import dealt_out, materialize

STEP = 10
#: Hashed vocabulary, dimensions of the latent space, extra directions of the random projection.
TERMS = 1 << 15
RANK = 64
EXTRA = 8
FIT_WORDS = 2_000_000
#: Least cosine of a candidate, for verbatim runs and for paraphrases; the README has the recall against brute force by its value.
MIN_COSINE = 0.45
PARAPHRASE_COSINE = 0.7
#: Characters of evaluation texts that are searched for in one pass over the corpus; more take several passes.
BLOCK_CHARS = 8_000_000
#: Words handled at a time, which bounds a task's memory.
CHUNK = 60_000
#: Cosines held at a time.
CELLS = 4_000_000

_BLOCK_TAG = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|td|th|tr|table|h[1-6]|body|html|head|title|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--[^>]*-->")
_WORD = re.compile(r"[^\W_]+")


def clean_words(text: str | None) -> list[str]:
    """Words of a text without markup, character references, invisible characters and compatibility forms."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf") if _has_invisible(text) else text
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")


def _has_invisible(text: str) -> bool:
    return _INVISIBLE.search(text) is not None


class _Terms(dict):
    """Hashed terms of the words seen so far; it starts anew when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = zlib.crc32(word.encode()) % TERMS
        return found


_terms = _Terms()
_term = _terms.__getitem__


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [clean_words(x) for x in b.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, words)], dtype=np.int64)
        flat = np.fromiter((_term(w) for ws in words for w in ws), np.int32, int(ends[-1]))
        terms = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(w) for w in words], pa.string()), terms], [b.schema.names[0], "norm", "t"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs, words = np.zeros(TERMS, np.int64), 0, 0
    for b in batches:
        t = b.column(0)
        docs, words = docs + len(t), words + len(t.flatten())
        for place, first, size, chunk in _chunks(t):
            own = np.unique(np.repeat(place, size) * TERMS + chunk)
            df += np.bincount(own % TERMS, minlength=TERMS)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(df[at], [docs, words]))], ["term", "n"])


def _chunks(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces of about ``CHUNK`` words: place of the document in the batch, first word in it, length, words.

    A document is one piece; a longer one than ``CHUNK`` is several, that share ``2 * STEP`` words with the next.
    """
    ends = np.asarray(lists.offsets)
    values = np.asarray(lists.values)
    at, n = 0, len(lists)
    while at < n:
        if ends[at + 1] - ends[at] > CHUNK:
            for first in range(0, int(ends[at + 1] - ends[at]), CHUNK):
                part = values[ends[at] + first : min(ends[at + 1], ends[at] + first + CHUNK + 2 * STEP)]
                yield np.array([at]), np.array([first]), np.array([len(part)]), part
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        size = np.diff(ends[at : to + 1])
        if size.any():
            yield np.arange(at, to), np.zeros(to - at, np.int64), size, values[ends[at] : ends[to]]
        at = to


def _blocks(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each block of STEP words, its document, and whether the next block is of the same document."""
    per_doc = -(-size // STEP)
    doc = np.repeat(np.arange(len(size)), per_doc)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = (np.cumsum(size) - size)[doc] + inner * STEP
    follows = np.append(doc[1:] == doc[:-1], False)
    return start, doc, follows


def _passages(weights: np.ndarray, words: np.ndarray, start: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Sums of the word rows over each passage: a block and the next of its document."""
    block = np.add.reduceat(weights[words], start, axis=0)
    block[:-1] += block[1:] * follows[:-1, None]
    return block


def _range_pass(idf: np.ndarray):
    """Accumulates the transposed matrix times (matrix times random directions), by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = RANK + EXTRA
        omega = np.random.default_rng(11).standard_normal((TERMS, ways), dtype=np.float32) * idf[:, None]
        total = np.zeros((TERMS, ways), np.float32)
        for b in batches:
            for _, _, size, words in _chunks(b.column(0)):
                start, _, follows = _blocks(size)
                y = _passages(omega, words, start, follows)
                y[1:] += y[:-1] * follows[:-1, None]  # a word lies in the passage of its block and the one before
                of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(words))))
                order = np.argsort(words, kind="stable")
                terms, first = np.unique(words[order], return_index=True)
                total[terms] += np.add.reduceat(y[of[order]], first, axis=0)
        at = np.flatnonzero(np.abs(total).sum(1))
        yield _vectors(at, total[at] * idf[at, None])

    return run


def _vectors(terms: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array([x.tobytes() for x in rows], pa.binary())], ["term", "v"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ways = RANK + EXTRA
    total, seen = np.zeros((TERMS, ways), np.float32), np.zeros(TERMS, bool)
    for b in batches:
        terms = np.asarray(b.column(0))
        np.add.at(total, terms, np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(len(terms), ways))
        seen[terms] = True
    at = np.flatnonzero(seen)
    yield _vectors(at, total[at])


def _gram_pass(idf: np.ndarray, q: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((q.shape[1], q.shape[1]))
        weights = q * idf[:, None]
        for b in batches:
            for _, _, size, words in _chunks(b.column(0)):
                start, _, follows = _blocks(size)
                y = _passages(weights, words, start, follows)
                gram += (y.T @ y).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary())], ["g"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


class LatentIndex:
    """Tokens of a corpus, term weights over all of it, and the latent basis."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        kind = f"{key} {docs.schema[key].dataType.simpleString()}, norm string, t array<int>"
        self.key = key
        self.tokens = materialize(dealt_out(docs.filter(F.col(text).isNotNull()).select(key, text)).mapInArrow(_tokens, kind), "tokens")
        counts = self.tokens.select("t").mapInArrow(_frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # TERMS + 2 rows at most
        counts = dict(zip(counts["term"], counts["n"]))
        self.docs, self.words = counts.pop(-1, 0), counts.pop(-2, 0)
        df = np.zeros(TERMS)
        df[list(counts)] = list(counts.values())
        self.idf = (np.log((1 + self.docs) / (1 + df)) + 1).astype(np.float32)
        self.basis = self._fit()

    def _fit(self) -> np.ndarray:
        """Random directions, orthonormalised after one pass, and turned by the eigenvectors of the second pass's small matrix."""
        share = min(1.0, FIT_WORDS / max(self.words, 1))
        sample = self.tokens if share == 1 else self.tokens.filter(F.pmod(F.xxhash64(F.lit("fit"), self.key), F.lit(1 << 20)) < int(share * (1 << 20)))
        parts = sample.select("t").mapInArrow(_range_pass(self.idf), "term int, v binary").repartition("term").mapInArrow(_combine, "term int, v binary")
        w = np.zeros((TERMS, RANK + EXTRA), np.float32)
        for row in parts.toLocalIterator():  # TERMS rows at most
            w[row.term] = np.frombuffer(bytes(row.v), np.float32)
        q = np.linalg.qr(w)[0].astype(np.float32)
        gram = np.zeros((RANK + EXTRA, RANK + EXTRA))
        for row in sample.select("t").mapInArrow(_gram_pass(self.idf, q), "g binary").toLocalIterator():
            gram += np.frombuffer(bytes(row.g)).reshape(gram.shape)
        vectors = np.linalg.eigh(gram)[1][:, ::-1][:, :RANK]
        return (q @ vectors.astype(np.float32) * self.idf[:, None]).astype(np.float32)


def _windows(words: list[str], width: int) -> list[list[str]]:
    """Windows of ``2 * STEP`` words every ``STEP`` words; the last one ends with the text."""
    last = max(0, len(words) - width)
    return [words[i : i + width] for i in sorted({*range(0, last, STEP), last})]


class _Queries:
    """A block of evaluation texts, prepared for the tasks: their windows in the latent space and as terms."""

    def __init__(self, basis: np.ndarray, texts: list[list[str]], run: int = 0):
        self.texts = texts
        of: dict[tuple[str, ...], set[int]] = {}
        for s, words in enumerate(texts):
            for w in _windows(words, 2 * STEP):
                of.setdefault(tuple(w), set()).add(s)
        self.windows, self.owners = list(of), [sorted(x) for x in of.values()]
        self.latent = _unit(np.array([basis[[_term(x) for x in w]].sum(0) for w in self.windows], np.float32)).T.copy() if of else np.zeros((basis.shape[1], 0), np.float32)
        self.terms = np.full((len(of), 2 * STEP), -1, np.int32)
        for i, w in enumerate(self.windows):
            self.terms[i, : len(w)] = [_term(x) for x in w]
        self.bits = _bits(self.terms)
        # Bits that a passage has in common with a window at least if they share a run.
        each = np.where(self.terms >= 0, np.uint64(1) << (self.terms.astype(np.int64) % 64).astype(np.uint64), np.uint64(0))
        starts = range(2 * STEP - run + 1)
        least = np.array([np.bitwise_count(np.bitwise_or.reduce(each[:, i : i + run], axis=1)) for i in starts]) if run else np.zeros((1, len(of)), np.uint8)
        whole = np.array([(self.terms[:, i : i + run] >= 0).all(1) for i in starts]) if run else np.ones((1, len(of)), bool)
        self.least = np.where(whole, least, 65).min(0).astype(np.uint8)
        self.rows_at_once = max(16, CELLS // max(1, len(of)))

    def candidates(self, unit: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (passage, window) with a cosine of at least ``least``."""
        for lo in range(0, len(unit), self.rows_at_once):
            p, w = np.nonzero(unit[lo : lo + self.rows_at_once] @ self.latent >= least)
            if len(p):
                yield p + lo, w


def _bits(terms: np.ndarray) -> np.ndarray:
    """A set of 64 bits for each row of terms; a negative term is none."""
    each = np.where(terms >= 0, np.uint64(1) << (terms.astype(np.int64) % 64).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(each, axis=1)


def _passage_terms(words: np.ndarray, start: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The terms of each passage; -2 beyond its document's end."""
    at = start[:, None] + np.arange(2 * STEP)
    inside = at < np.cumsum(size)[doc][:, None]
    return np.where(inside, words[np.minimum(at, len(words) - 1)], -2).astype(np.int32)


def _may_share(a: np.ndarray, b: np.ndarray, run: int) -> np.ndarray:
    """Which rows of two term matrices may share a run: one of at least ``STEP`` terms holds the half run before or after the middle of ``a``."""
    if run < STEP:
        return np.ones(len(a), bool)
    half = run // 2
    found = np.zeros(len(a), bool)
    for first in (STEP - half, STEP):
        held = b[:, : 2 * STEP - half + 1] == a[:, first, None]
        for k in range(1, half):
            held &= b[:, k : 2 * STEP - half + 1 + k] == a[:, first + k, None]
        found |= held.any(1)
    return found


def _common_runs(a: np.ndarray, b: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two term matrices that share a run of ``run`` terms: row, and its start on either side, each place once."""
    same = a[:, :, None] == b[:, None, :]
    done, held = 1, same
    while done < run:  # held: runs of ``done`` terms begin here; each step doubles them as far as it may
        more = min(done, run - done)
        longer = np.zeros_like(held)
        longer[:, : -more, : -more] = held[:, : -more, : -more] & held[:, more:, more:]
        held, done = longer, done + more
    return np.nonzero(held)


def leaked(index: LatentIndex, items: DataFrame, name: str, texts: list[str], run: int = STEP, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Pairs (document, item) where both share a run of at least ``run`` consecutive words.

    Candidates are the pairs of a passage and a window of an item with a cosine of ``min_cosine``
    or more in the latent space; of these, and only these, the longest common run of words is
    looked at. ``items`` has the id ``name`` and text columns ``texts``; an id may come with several texts.
    Texts of fewer words than a run, null ids and null texts have no pairs. Each pair comes once.
    """
    if run > STEP + 1:
        raise ValueError("a run must fit into a passage whatever its start")
    key, spark = index.key, index.tokens.sparkSession
    kind = f"{key} {index.tokens.schema[key].dataType.simpleString()}, item string"
    basis = spark.sparkContext.broadcast(index.basis)

    def search_for(block):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, names = block.value
            for b in batches:
                found: set[tuple[int, str]] = set()
                split: dict[int, list[str]] = {}  # words of documents with a hit
                for place, first, size, words in _chunks(b.column(2)):
                    start, doc, follows = _blocks(size)
                    unit = _unit(_passages(basis.value, words, start, follows))
                    terms = _passage_terms(words, start, doc, size)
                    bits = _bits(terms)
                    offset = np.cumsum(size) - size
                    for ps, ws in q.candidates(unit, min_cosine):
                        near = np.bitwise_count(bits[ps] & q.bits[ws]) >= q.least[ws]
                        ps, ws = ps[near], ws[near]
                        near = _may_share(terms[ps], q.terms[ws], run)
                        ps, ws = ps[near], ws[near]
                        for lo in range(0, len(ps), CELLS // (4 * STEP * STEP)):
                            p, w = ps[lo : lo + CELLS // (4 * STEP * STEP)], ws[lo : lo + CELLS // (4 * STEP * STEP)]
                            for pair, i, j in zip(*(x.tolist() for x in _common_runs(terms[p], q.terms[w], run))):
                                at, window = int(p[pair]), int(w[pair])
                                d = int(doc[at])
                                row, inner = int(place[d]), int(first[d] + start[at] - offset[d]) + i
                                if row not in split:
                                    split[row] = b.column(1)[row].as_py().split(" ")
                                if tuple(split[row][inner : inner + run]) == q.windows[window][j : j + run]:
                                    found.update((row, n) for s in q.owners[window] for n in names[s])
                hits = sorted(found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in hits], pa.int64())), pa.array([n for _, n in hits], pa.string())], [key, "item"])

        return search

    out = spark.createDataFrame([], kind)
    for rows in item_blocks(items, name, texts):
        owners: dict[tuple[str, ...], set[str]] = {}
        for n, *said in rows:
            for text in said:
                if len(words := clean_words(text)) >= run:
                    owners.setdefault(tuple(words), set()).add(str(n))
        if owners:
            block = spark.sparkContext.broadcast((_Queries(index.basis, [list(w) for w in owners], run), [sorted(x) for x in owners.values()]))
            out = out.unionByName(index.tokens.select(key, "norm", "t").mapInArrow(search_for(block), kind))
    return out


def item_blocks(items: DataFrame, name: str, texts: list[str]) -> Iterator[list[tuple]]:
    """The evaluation texts in blocks of about ``BLOCK_CHARS`` characters, by a hash of the id, which hold the driver and the tasks to that size.

    Each block is a list of (id, text, ...). Null ids are left out. An id that is repeated comes as often.
    """
    rows = items.filter(F.col(name).isNotNull()).select(name, *texts)
    size = rows.agg(F.sum(sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0)))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    for b in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.filter(F.pmod(F.xxhash64(F.col(name)), F.lit(n)) == b)).collect()]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, bit-parallel over the first."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for w in b:
        if m := at.get(w):
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _answers(said: list[list[str]]) -> list[set[str]]:
    """The words of each text of an item that none of its other texts has: what tells them apart, and so answers the item."""
    return [set(a).difference(*(b for b in said if b != a)) for a in said]


def paraphrased(index: LatentIndex, items: DataFrame, name: str, texts: list[str], min_cosine: float = PARAPHRASE_COSINE, share: float = 0.8) -> DataFrame:
    """Pairs (document, item, lcs_permille, answered): a passage as long as a text of the item keeps its word order but for a few words.

    Candidates are passages with a cosine of ``min_cosine`` or more to a window of the text;
    around each, the words of the document as many as the text has on either side are compared by
    the longest common subsequence, which must hold ``share`` of the text's words. Of several
    passages and texts the best counts. ``answered`` tells whether, in one of these passages, all the words
    stand by which that text differs from the item's other texts, so that the answer leaked too;
    a text that differs by no word is never answered. Texts of fewer than five words are left out.
    """
    key, spark = index.key, index.tokens.sparkSession
    kind = f"{key} {index.tokens.schema[key].dataType.simpleString()}, item string, lcs_permille int, answered boolean"
    basis = spark.sparkContext.broadcast(index.basis)

    def search_for(block):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, names, answers = block.value
            sets = [set(w) for w in q.texts]
            for b in batches:
                best: dict[tuple[int, str], tuple[int, bool]] = {}
                split: dict[int, list[str]] = {}  # words of documents with a candidate
                for place, first, size, words in _chunks(b.column(2)):
                    start, doc, follows = _blocks(size)
                    unit = _unit(_passages(basis.value, words, start, follows))
                    offset = np.cumsum(size) - size
                    for ps, ws in q.candidates(unit, min_cosine):
                        for p, s in {(p, s) for p, w in zip(ps.tolist(), ws.tolist()) for s in q.owners[w]}:
                            d, item = int(doc[p]), q.texts[s]
                            row, inner = int(place[d]), int(first[d] + start[p] - offset[d])
                            if row not in split:
                                split[row] = b.column(1)[row].as_py().split(" ")
                            near = split[row][max(0, inner - len(item)) : inner + 2 * STEP + len(item)]
                            if len(sets[s].intersection(near)) < share * len(sets[s]):  # no subsequence can be long enough
                                continue
                            permille = 1000 * lcs_length(item, near) // len(item)
                            if permille >= 1000 * share:
                                had, right = best.get((row, names[s]), (0, False))
                                best[row, names[s]] = max(permille, had), right or (bool(answers[s]) and answers[s].issubset(near))
                hits = sorted(best)
                columns = [b.column(0).take(pa.array([r for r, _ in hits], pa.int64())), pa.array([n for _, n in hits], pa.string()), pa.array([best[h][0] for h in hits], pa.int32()), pa.array([best[h][1] for h in hits], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [key, "item", "lcs_permille", "answered"])

        return search

    out = spark.createDataFrame([], kind)
    for rows in item_blocks(items, name, texts):
        seqs, names, answers = [], [], []
        for n, *said in rows:
            said = [clean_words(t) for t in said]
            for words, own in zip(said, _answers(said)):
                if len(words) >= 5:
                    seqs.append(words), names.append(str(n)), answers.append(own)
        if seqs:
            block = spark.sparkContext.broadcast((_Queries(index.basis, seqs), names, answers))
            out = out.unionByName(index.tokens.select(key, "norm", "t").mapInArrow(search_for(block), kind))
    return out.groupBy(key, "item").agg(F.max("lcs_permille").alias("lcs_permille"), F.max("answered").alias("answered"))
