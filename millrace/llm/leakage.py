"""Evaluation texts in a training corpus: a positional inverted index, distributed by documents.

``build_index`` turns the corpus into segments. A segment holds whole documents of bounded size together and, for each of
its terms, the sorted list of the term's positions. ``search`` sends the test items past all segments in blocks of bounded
size, several blocks in one pass: every three words in a row of an item are looked up from the posting list of the rarest of the three,
shifted by its place and intersected with the lists of the others; where two or more such hits lie on about one
diagonal of item and document, the words around them are aligned, which tolerates exchanged and inserted words. A match says where
it lies, and whether it is an exact phrase or words in proximity.
No posting is grouped or sorted again: an item's hits in a document all lie in one segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.sources import workspace
from millrace.sources.workers import ship

# LaTeX commands whose argument is markup and not text.
_MARKUP = re.compile(r"\\(?:begin|end|cite[a-z]*|label|ref|eqref|input|include|includegraphics|bibliography|bibliographystyle|usepackage|documentclass|vspace|hspace)\*?(?:\[[^\[\]]*\])*\{[^{}]*\}|\\[a-zA-Z]+\*?")
_WORD = re.compile(r"[^\W_]+")

#: Words in a row that make a hit, hits that make a candidate, and the width of a diagonal in words.
RUN, HITS, BAND = 3, 2, 16
#: Share of an item's words that make a passage, share of a passage that may be exchanged words, and share of the rest that
#: must not be stock phrases.
SHARE, EXCHANGED, OWN = 1 / 3, 1 / 6, 1 / 2
#: Candidates that are aligned at once.
TOGETHER = 128
#: A run of words in more than this share of the different items (and in more than 3) is a stock phrase.
STOCK = 0.01
#: Tokens of a segment; items of a block and bytes of their text; blocks that one pass over the index takes; segments of a task.
SEGMENT_TOKENS, BLOCK_ITEMS, BLOCK_BYTES, PASS_BLOCKS, TASK_SEGMENTS = 400_000, 4096, 8 << 20, 8, 4
#: What kinds of matches there are: a phrase of a passage's length word by word, or words in order with others between or exchanged.
EXACT, PROXIMITY = "exact", "proximity"
MATCH = "doc_id long, item_id long, n_matched int, n_own int, n_words int, first_word int, phrase_words int, kind string"

SEGMENT = "doc_ids array<long>, doc_starts array<int>, terms binary, lengths binary, gaps binary"


def words(text: str) -> list[str]:
    """The words of a text in lower case, without markup; formulas give their letters and numbers."""
    return _WORD.findall(_MARKUP.sub(" ", text).lower())


def term(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def _segment(ids: list[int], starts: list[int], tokens: list[int], vocabulary: dict[str, int]) -> pd.DataFrame:
    hashes = np.fromiter(map(term, vocabulary), np.int64, len(vocabulary))
    rank = np.empty(len(hashes), np.int64)
    rank[np.argsort(hashes, kind="stable")] = np.arange(len(hashes))
    token = rank[np.asarray(tokens, np.int64)] if tokens else np.empty(0, np.int64)
    positions = np.argsort(token, kind="stable")
    lengths = np.bincount(token, minlength=len(hashes))
    gaps = np.diff(positions, prepend=0)
    firsts = np.cumsum(lengths)[:-1]
    gaps[firsts] = positions[firsts]
    row = {"doc_ids": ids, "doc_starts": starts, "terms": np.sort(hashes).tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "gaps": gaps.astype(np.int32).tobytes()}
    return pd.DataFrame([row])


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, starts, tokens, vocabulary = [], [], [], {}
    for pdf in batches:
        for i, text in zip(pdf["id"], pdf["text"], strict=True):
            ids.append(int(i))
            starts.append(len(tokens))
            tokens += [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            if len(tokens) >= SEGMENT_TOKENS:
                yield _segment(ids, starts, tokens, vocabulary)
                ids, starts, tokens, vocabulary = [], [], [], {}
    if ids:
        yield _segment(ids, starts, tokens, vocabulary)


def build_index(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of the index, kept as a table. Rows whose id or text is null aren't indexed; an empty text has no
    postings. Ids are integers; repeated ids are separate documents.
    """
    ship(documents.sparkSession)
    rows = documents.select(col(id).cast("long").alias("id"), col(text).alias("text")).dropna()
    return workspace.keep(rows.mapInPandas(_index, SEGMENT), "positional-index")


class Segment:
    """One segment opened for search."""

    def __init__(self, row):
        self.doc_ids, self.doc_starts = np.asarray(row.doc_ids, np.int64), np.asarray(row.doc_starts, np.int64)
        self.terms, self.lengths, gaps = np.frombuffer(row.terms, np.int64), np.frombuffer(row.lengths, np.int32).astype(np.int64), np.frombuffer(row.gaps, np.int32).astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        total = np.cumsum(gaps)
        before = np.concatenate(([0], total))[self.begins] if len(gaps) else self.begins
        self.positions = total - np.repeat(before, self.lengths)
        self.n = len(gaps)
        #: All postings as one ascending list, by term and position, in which the list of every term can be searched.
        self.postings = np.repeat(np.arange(len(self.terms)), self.lengths) * np.int64(self.n + 1) + self.positions
        #: The term at each position, from the postings; ``BAND`` words of none on either side.
        self.at = np.full(self.n + 2 * BAND, -1, np.int64)
        self.at[self.positions + BAND] = np.repeat(np.arange(len(self.terms)), self.lengths)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The segment's number of each term, -2 if it has none."""
        if not len(self.terms):
            return np.full(len(hashes), -2)
        k = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[k] == hashes, k, -2)

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether the list of each term has a position."""
        wanted = terms * np.int64(self.n + 1) + positions
        k = np.searchsorted(self.postings, wanted)
        return (k < self.n) & (self.postings[np.minimum(k, self.n - 1)] == wanted)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, position, side="right") - 1

    def phrases(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of terms (one per row, by number) occur: the row and the position of its first word.

        Each run starts from the list of its rarest term, shifted by the term's place, and is intersected
        with the others' lists, the rarer first.
        """
        width = runs.shape[1]
        usable = np.flatnonzero((runs >= 0).all(axis=1))
        out_run, out_at = [], []
        count = self.lengths[runs[usable]]
        by_size = count.argsort(axis=1, kind="stable")
        size = count[np.arange(len(usable)), by_size[:, 0]]
        for part in np.array_split(np.arange(len(usable)), max(1, int(size.sum()) // 1_000_000 + 1)):
            u, r, s = usable[part], by_size[part], size[part]
            which = np.repeat(np.arange(len(u)), s)
            within = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
            first = self.positions[self.begins[runs[u, r[:, 0]]][which] + within] - r[which, 0]
            ok = (first >= 0) & (first + width <= self.n)
            which, first = which[ok], first[ok]
            for k in range(1, width):
                place = r[which, k]
                ok = self.holds(runs[u[which], place], first + place)
                which, first = which[ok], first[ok]
            inside = self.doc(first) == self.doc(first + width - 1)
            out_run.append(u[which[inside]])
            out_at.append(first[inside])
        return np.concatenate(out_run), np.concatenate(out_at)


_S, _T = 1 << 40, 1 << 20


def align(items: list[np.ndarray], owns: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of an item and a text, the words in their best local alignment and those that are the item's ``own``
    (of no stock phrase).

    A match scores 1, an exchanged, missing or inserted word -1; ties go to more words. All pairs advance together.
    """
    n, depth, width = len(items), max(map(len, items)), max(map(len, texts))
    # no padding equals any term, nor do terms that the segment lacks (-2)
    item, own, text = np.full((depth, n), -3, np.int64), np.zeros((depth, n), np.int64), np.full((n, width), -1, np.int64)
    for k, (a, o, t) in enumerate(zip(items, owns, texts, strict=True)):
        item[: len(a), k], own[: len(a), k], text[k, : len(t)] = a, o, t
    ramp = np.arange(width + 1, dtype=np.int64) * _S
    row, best = np.zeros((n, width + 1), np.int64), np.zeros(n, np.int64)
    for word, mine in zip(item, own, strict=True):
        new = row - _S
        np.maximum(new[:, 1:], row[:, :-1] + np.where(text == word[:, None], (_S + _T + mine)[:, None], -_S), out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, axis=1, out=new)
        new -= ramp
        new[new < _S // 2] = 0
        row = new
        np.maximum(best, row.max(axis=1), out=best)
    return best % _S // _T, best % _T


class Items:
    """A block of test items, ready to be searched."""

    def __init__(self, rows: list[tuple[int, list[str]]], stock: set[tuple[int, ...]]):
        self.ids = [i for i, _ in rows]
        self.words = [np.fromiter(map(term, w), np.int64, len(w)) for _, w in rows]
        self.own, runs, place = [], {}, []
        for n, w in enumerate(self.words):
            own = np.zeros(len(w), bool)
            for k in range(len(w) - RUN + 1):
                run = tuple(w[k : k + RUN].tolist())
                if run not in stock:
                    own[k : k + RUN] = True
                    place.append((runs.setdefault(run, len(runs)), n, k))
            self.own.append(own)
        self.runs = np.array(list(runs), np.int64).reshape(-1, RUN)
        self.n_runs = np.bincount(np.array([n for _, n, _ in place], np.int64), minlength=len(rows))
        place = np.array(sorted(place), np.int64).reshape(-1, 3)
        self.place_begin = np.searchsorted(place[:, 0], np.arange(len(runs) + 1))
        self.place_item, self.place_offset = place[:, 1], place[:, 2]
        self.vocabulary, self.run_terms = np.unique(self.runs, return_inverse=True)
        self.run_terms = self.run_terms.reshape(-1, RUN)


def _matches(segment: Segment, items: Items) -> Iterator[tuple]:
    if not segment.n or not len(items.runs):
        return
    run, at = segment.phrases(segment.find(items.vocabulary)[items.run_terms])
    times = items.place_begin[run + 1] - items.place_begin[run]
    place = np.repeat(items.place_begin[run] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    at, item, offset = np.repeat(at, times), items.place_item[place], items.place_offset[place]
    if not len(at):
        return
    doc, diagonal = segment.doc(at), at - offset
    order = np.lexsort((offset, diagonal, item, doc))
    doc, item, diagonal, at, offset = doc[order], item[order], diagonal[order], at[order], offset[order]
    # hits of one document and item whose diagonals follow closely are one candidate
    same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
    new = np.append(True, ~same | (diagonal[1:] - diagonal[:-1] > BAND))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc))
    # hits on one diagonal, each a word on, are one phrase
    apart = np.append(True, ~same | (diagonal[1:] != diagonal[:-1]) | (offset[1:] - offset[:-1] != 1))
    since = np.arange(len(doc)) - np.maximum.accumulate(np.where(apart, np.arange(len(doc)), 0))
    phrase = np.maximum.reduceat(since, begin) + RUN
    # a candidate needs several different runs of its item, or all that the item has
    group = np.cumsum(new) - 1
    runs_hit = np.bincount(np.unique(np.stack([group, offset], axis=1), axis=0)[:, 0], minlength=len(begin))
    keep = runs_hit >= np.minimum(HITS, items.n_runs[item[begin]])
    # pairs of like size are aligned together
    size = np.array([len(w) for w in items.words], np.int64)[item[begin[keep]]]
    chosen = np.stack([begin[keep], end[keep], phrase[keep]], axis=1)[np.argsort(size, kind="stable")]
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for part in np.array_split(chosen, max(1, -(-len(chosen) // TOGETHER))) if len(chosen) else []:
        pairs, texts, places = [], [], []
        for a, b, length in part.tolist():
            d, i = int(doc[a]), int(item[a])
            n = len(items.words[i])
            bounds = segment.doc_starts[d], segment.doc_starts[d + 1] if d + 1 < len(segment.doc_starts) else segment.n
            low, high = max(bounds[0], diagonal[a] - n // 2), min(bounds[1], diagonal[b - 1] + n + n // 2 + 1)
            pairs.append((d, i))
            texts.append(segment.at[low + BAND : high + BAND])
            places.append((int(at[a:b].min() - bounds[0]), length))
        totals, owns = align([segment.find(items.words[i]) for _, i in pairs], [items.own[i] for _, i in pairs], texts)
        for pair, total, own, (first, length) in zip(pairs, totals.tolist(), owns.tolist(), places, strict=True):
            # of matches that are equally good the first in the text
            found[pair] = max(found.get(pair, (0, 0, 0, 0)), (total, own, length, -first))
    for (d, i), (total, own, length, first) in found.items():
        n = len(items.words[i])
        least = SHARE * (1 - EXCHANGED) * n
        if total >= least and own >= OWN * least:
            yield int(segment.doc_ids[d]), items.ids[i], total, own, n, -first, length, EXACT if length >= SHARE * n else PROXIMITY


def _blocks(items: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for row in items.select(col(id).cast("long"), col(text)).dropna().toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row[1]) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], words(row[1])))
        size += len(row[1])
    if block:
        yield block


def stock_phrases(items: DataFrame, id: str = "item_id", text: str = "item_text") -> set[tuple[int, ...]]:
    """Runs of words that more than ``STOCK`` of the different items share; there are at most some hundred such runs per
    word of an item, whatever the number of items."""
    ship(items.sparkSession)
    runs = F.pandas_udf(lambda s: s.map(lambda t: [list(x) for x in {tuple(map(term, w[k : k + RUN])) for w in [words(t)] for k in range(len(w) - RUN + 1)}]), "array<array<long>>")
    runs.func.__annotations__ = {}
    texts = items.select(col(text).alias("t")).dropna().distinct()
    n = texts.count()
    common = texts.select(F.explode(runs("t")).alias("run")).groupBy("run").count().filter(F.col("count") > max(3, STOCK * n))
    return {tuple(r.run) for r in common.toLocalIterator()}


def search(index: DataFrame, items: DataFrame, id: str = "item_id", text: str = "item_text") -> DataFrame:
    """Passages of the items in the indexed documents, one row per document and item: ``doc_id, item_id``, the item's words in the best
    match, those among them that are its own, the item's words in all, and of the match the place of its first hit in the document's
    words, its longest phrase in words and its kind.

    A document counts if its best alignment with an item makes a passage of ``SHARE`` of the item's words, of which up to
    ``EXCHANGED`` may be others, and ``OWN`` of the rest are the item's own and no stock phrase. Items with a null id or text, or with fewer than three words, match nothing; of items
    with one id each counts by itself. The items pass in blocks of ``BLOCK_ITEMS`` and ``BLOCK_BYTES`` at most, of which a pass over
    the index takes ``PASS_BLOCKS``; so what is broadcast is bounded however many there are.
    """
    spark, stock, parts = index.sparkSession, stock_phrases(items, id, text), []
    # segments weigh alike, so tasks do that have as many; files and their splits say nothing of that
    spread = index.repartition(max(1, -(-index.count() // TASK_SEGMENTS)))
    columns = [c.split()[0] for c in MATCH.split(", ")]
    for blocks in _passes(items, id, text):
        shared = spark.sparkContext.broadcast([Items(block, stock) for block in blocks])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    segment = Segment(row)
                    for block in shared.value:
                        yield pd.DataFrame(list(_matches(segment, block)), columns=columns)

        parts.append(spread.mapInPandas(run, MATCH))
    if not parts:
        return spark.createDataFrame([], MATCH)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _passes(items: DataFrame, id: str, text: str) -> Iterator[list]:
    blocks = _blocks(items, id, text)
    while some := list(islice(blocks, PASS_BLOCKS)):
        yield some


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents and the items that leaked into them, from ``doc_id, text`` and ``item_id, item_text``."""
    return search(build_index(documents), items)
