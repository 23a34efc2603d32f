"""Passages of held-out items inside a corpus, by Wu-Manber search over words.

Every item is cut into patterns of ``PATTERN`` words that start every
``STRIDE`` words, so any exact run of ``PATTERN + STRIDE - 1`` words holds a
whole pattern. A passage of 25 or more words with at most one change in fifteen
has such a run. The scan moves a window of ``PATTERN`` words over each document:
a shift table over the window's last two words skips positions where no pattern
can end, the bucket of that suffix selects patterns, and a direct comparison of
all words confirms each. Confirmed seeds are then checked exactly by aligning
the item with the document around them.

The scan is vectorised across documents: all documents of a batch move their
windows in lock-step, so the cost is a few array operations per step.

Stock clauses never count. A sentence of an item is one if otherwise different
items share it word for word, or if it stands by itself, without the item's
words before and after it, in at least ``STOCK_RATE`` of the documents (and in
``STOCK_DOCUMENTS``), amid different words each time. The scan notes where an
item's sentence stands by itself, and what precedes it there; these notes are
counted over the whole corpus, and the passages of items that prove to have
such a sentence are found again, without it, from the words kept of them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cloakframe.llm.lookalikes import comparable_words
from cloakframe.session import collect_bounded, cut

PATTERN = 7
STRIDE = 4
MIN_WORDS = 25
CHANGE_RATE = 15
MAX_ITEMS = 50_000
MAX_CHARS = 64_000_000  # of all items together, shipped to every task
STOCK_WORDS = 12
STOCK_RATE = 0.002
STOCK_DOCUMENTS = 8
AROUND = 6  # words of the item on either side of a sentence that tell whether it stands by itself
BEFORE = 12  # words of the document before such a sentence that tell one place from another
_END = re.compile(r"(?<=[.!?…])\s+(?=[^a-zß-ÿ])")


def sentences_of(text: str) -> list[tuple[str, ...]]:
    return [words for s in _END.split(text) if (words := tuple(comparable_words(s)))]


def stock_sentences(texts: list[list[tuple[str, ...]]]) -> set[tuple[str, ...]]:
    """Sentences of at least ``STOCK_WORDS`` words that otherwise different items share word for word.

    Items are otherwise different if the sentences that both hold make up less
    than half of the words of either; one text under two ids shares all of it.
    """
    owners: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i, sentences in enumerate(texts):
        for words in {*sentences}:
            if len(words) >= STOCK_WORDS:
                owners[words].append(i)
    out = set()
    for words, (first, *rest) in owners.items():
        held = {*texts[first]}
        size = sum(map(len, texts[first]))
        for other in rest:
            shared = sum(len(w) for w in texts[other] if w in held)
            if 2 * shared < min(size, sum(map(len, texts[other]))):
                out.add(words)
                break
    return out


class WuManber:
    """Shift table, suffix buckets and patterns of all items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        self.sentences: list[list[tuple[int, int]]] = []
        texts = [sentences_of(text) for _, text in items]
        stock = stock_sentences(texts)
        for sentences in texts:
            ids, at = [], []
            for words in sentences:
                if len(words) >= STOCK_WORDS and words not in stock:
                    at.append((len(ids), len(words)))
                ids += [-1] * len(words) if words in stock else [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            self.words.append(np.array(ids, np.int64))
            self.sentences.append(at)
        patterns = {}
        owners: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, ids in enumerate(self.words):
            last = len(ids) - PATTERN
            for k in sorted({*range(0, last + 1, STRIDE), last}) if last >= 0 else ():
                window = ids[k : k + PATTERN]
                if (window > 0).all():
                    patterns[window.tobytes()] = window
                    owners[window.tobytes()].append((n, k))
        self.patterns = np.array([*patterns.values()], np.int64).reshape(-1, PATTERN)
        self.owners = [owners[key] for key in patterns]
        self.mask = (1 << min(24, max(20, len(patterns).bit_length() + 6))) - 1
        self.shift = np.full(self.mask + 1, PATTERN - 1, np.int8)
        for j in range(PATTERN - 1):
            code = self.code(self.patterns[:, j], self.patterns[:, j + 1])
            np.minimum.at(self.shift, code, np.int8(PATTERN - 2 - j))
        suffix = self.code(self.patterns[:, -2], self.patterns[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 1_000_003) ^ (b * 7_919)) & self.mask

    def scan(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Confirmed (document, position of the window's first word, pattern), in lock-step over documents."""
        doc = np.nonzero(ends - starts >= PATTERN)[0]
        at = starts[doc] + PATTERN - 1
        while len(doc):
            code = self.code(flat[at - 1], flat[at])
            step = self.shift[code]
            hit = np.nonzero(step == 0)[0]
            if len(hit):
                lo = np.searchsorted(self.suffix, code[hit], "left")
                n = np.searchsorted(self.suffix, code[hit], "right") - lo
                row = np.repeat(hit, n)
                pattern = self.order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                first = at[row] - (PATTERN - 1)
                same = flat[first] == self.patterns[pattern, 0]
                row, pattern, first = row[same], pattern[same], first[same]
                for j in range(1, PATTERN):
                    same = flat[first + j] == self.patterns[pattern, j]
                    row, pattern, first = row[same], pattern[same], first[same]
                if len(row):
                    yield doc[row], first, pattern
            at = at + np.maximum(step, 1)
            live = at < ends[doc]
            doc, at = doc[live], at[live]

    @staticmethod
    def passage(item: np.ndarray, text: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        """The longest passage near the seeds: (document word, item word, words, changes), or None."""
        if len(item) < MIN_WORDS or not promising(item, text):
            return None
        best = None
        for diagonal in {d - i for d, i in seeds}:
            lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
            same = item[lo:hi] == text[lo + diagonal : hi + diagonal]
            found = longest(np.where(same, 1, 1 - CHANGE_RATE), same)
            if found and (best is None or found[1] > best[2]):
                best = (lo + found[0] + diagonal, lo + found[0], found[1], found[2])
        a = max(0, min(d - i for d, i in seeds) - 10)
        b = min(len(text), max(d - i for d, i in seeds) + len(item) + 10)
        if longest_run(item, text, seeds) < PATTERN + STRIDE - 1:
            return best
        score, same, where = [], [], []
        i0 = d0 = 0
        matcher = SequenceMatcher(None, item.tolist(), text[a:b].tolist(), autojunk=False)
        for i, d, n in matcher.get_matching_blocks():
            for k in range(max(i - i0, d - d0)):
                score.append(1 - CHANGE_RATE)
                same.append(False)
                where.append((min(i0 + k, max(i - 1, i0)), min(d0 + k, max(d - 1, d0))))
            score += [1] * n
            same += [True] * n
            where += [(i + k, d + k) for k in range(n)]
            i0, d0 = i + n, d + n
        found = longest(np.array(score), np.array(same, bool))
        if found is None or best and best[2] >= found[1]:
            return best
        i, d = where[found[0]]
        return a + d, i, found[1], found[2]

    def alone(self, n: int, text: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(sentence, its place in the text) of each long sentence of an item that stands by itself near the seeds."""
        item, out = self.words[n], []
        for k, (at, size) in enumerate(self.sentences[n]):
            for diagonal in {d - i for d, i in seeds if at <= i < at + size}:
                lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
                if lo > at or hi < at + size:
                    continue
                same = item[lo:hi] == text[lo + diagonal : hi + diagonal]
                inside = same[at - lo : at + size - lo]
                beside = [*same[max(0, at - AROUND - lo) : at - lo], *same[at + size - lo : at + size + AROUND - lo]]
                if 10 * inside.sum() >= 9 * size and 2 * sum(beside) <= len(beside):
                    out.append((k, at + diagonal))
        return out

    def find(self, texts: list[str]) -> Iterator[tuple]:
        """(text, item, passage or None, sentences by themselves, what precedes them, first word kept, words kept, seeds)."""
        get, zero = self.vocabulary.get, repeat(0)
        flat_list: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            flat_list.extend(map(get, comparable_words(t), zero))
            ends[k] = len(flat_list)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        flat = np.array(flat_list, np.int64)
        seeds: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for docs, firsts, patterns in self.scan(flat, starts, ends):
            for d, first, p in zip(docs.tolist(), firsts.tolist(), patterns.tolist()):
                for n, k in self.owners[p]:
                    seeds[d, n].append((first - int(starts[d]), k))
        for (d, n), where in seeds.items():
            text = flat[starts[d] : ends[d]]
            found = self.passage(self.words[n], text, where)
            alone = self.alone(n, text, where)
            if not found and not alone:
                continue
            words = comparable_words(texts[d]) if alone else []
            before = [xxhash.xxh3_64_intdigest(" ".join(words[max(0, at - BEFORE) : at])) - (1 << 63) for _, at in alone]
            a = max(0, min(d - i for d, i in where) - 10)
            b = max(d - i for d, i in where) + len(self.words[n]) + 10
            kept, near = (text[a:b].tolist(), [x for d, i in where for x in (d - a, i)]) if found else ([], [])
            yield d, n, found, [k for k, _ in alone], before, a, kept, near

    def without(self, n: int, stock: Iterable[int], kept: list[int], seeds: list[int]) -> tuple[int, int, int, int] | None:
        """The passage found again from the words kept, the item's stock sentences blanked."""
        item = self.words[n].copy()
        for k in stock:
            at, size = self.sentences[n][k]
            item[at : at + size] = -1
        where = [(d, i) for d, i in zip(seeds[::2], seeds[1::2]) if (item[i : i + PATTERN] > 0).all()]
        return self.passage(item, np.array(kept, np.int64), where) if where else None


def promising(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether some 25 words of the item have at most six of their 24 word pairs missing in the text.

    A passage of 25 words or more with one change in fifteen always has such a
    part: three changes at most fall into its best 25 words, each hitting two pairs.
    """
    pairs = np.isin(item[:-1] * 1_000_003 + item[1:], text[:-1] * 1_000_003 + text[1:])
    total = np.concatenate([[0], np.cumsum(pairs)])
    return bool((total[MIN_WORDS - 1 :] - total[: -(MIN_WORDS - 1)]).max() >= MIN_WORDS - 7)


def longest_run(item: np.ndarray, text: np.ndarray, seeds: list[tuple[int, int]]) -> int:
    """Longest exact run through any of the seeds."""
    most = 0
    for d, i in seeds:
        n = PATTERN
        while i + n < len(item) and d + n < len(text) and item[i + n] == text[d + n]:
            n += 1
        while i > 0 and d > 0 and item[i - 1] == text[d - 1]:
            i, d, n = i - 1, d - 1, n + 1
        most = max(most, n)
    return most


def longest(score: np.ndarray, same: np.ndarray) -> tuple[int, int, int] | None:
    """Longest stretch with a score of zero or more, without changed words at its ends beyond ``MIN_WORDS``: (start, words, changes)."""
    if len(score) < MIN_WORDS or same.sum() < MIN_WORDS - MIN_WORDS // CHANGE_RATE:
        return None
    total = np.concatenate([[0], np.cumsum(score)])
    best = None
    low = np.minimum.accumulate(total)
    for j in range(len(score), MIN_WORDS - 1, -1):
        if best and j <= best[1]:
            break
        if low[j - MIN_WORDS] > total[j]:
            continue
        i = int(np.argmax(low[: j + 1] <= total[j]))
        if best is None or j - i > best[1]:
            best = (i, j - i)
    if best is None:
        return None
    i, n = best
    while n > MIN_WORDS and not same[i + n - 1]:
        n -= 1
    while n > MIN_WORDS and not same[i]:
        i, n = i + 1, n - 1
    inside = same[i : i + n]
    return i, n, int(n - inside.sum())


def _typed(column: str, df: DataFrame) -> str:
    return df.schema[column].dataType.simpleString()


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Every document with at least 25 running words of an item, at most one in fifteen changed.

    Items are a stated query set that is documented not to grow: ``MAX_ITEMS``
    of them and ``MAX_CHARS`` characters are shipped once to every task (more
    raises) and searched in one pass over all documents. Sentences that
    different items share, or that stand by themselves in many documents, are
    stock clauses and never count. Null and empty texts on either side find
    nothing, repeated documents each get their rows, repeated items count once,
    ids keep their type, and extra columns are ignored.
    Returns one row for each document and item with the longest passage.
    """
    spark = documents.sparkSession
    rows = collect_bounded(items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).dropna().distinct(), MAX_ITEMS, "items")
    held = sorted((r.i, r.t) for r in rows)
    if sum(len(t) for _, t in held) > MAX_CHARS:
        raise ValueError(f"items have more than {MAX_CHARS} characters; raise the documented bound on purpose")
    shipped = spark.sparkContext.broadcast([*enumerate(t for _, t in held)])
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text != ''")
    kinds = [pa.int32()] * 6 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["item", "doc_word", "item_word", "n_words", "n_changed", "kept_from", "alone", "before", "kept", "seeds"]
    schema = f"doc_id {_typed('doc_id', docs)}, item int, doc_word int, item_word int, n_words int, n_changed int, kept_from int, alone array<int>, before array<long>, kept array<int>, seeds array<int>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WuManber(shipped.value)
        for batch in batches:
            out, of = [], []
            for d, n, found, alone, before, a, kept, seeds in automaton.find(batch.column(1).to_pylist()):
                of.append(d)
                out.append((n, *(found or (None,) * 4), a, alone, before, kept, seeds))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", *names])

    notes = cut(docs.mapInArrow(search, schema))
    least = max(STOCK_DOCUMENTS, STOCK_RATE * documents.count())
    places = notes.select("item", F.explode(F.arrays_zip("alone", "before")).alias("x")).groupBy("item", F.col("x.alone").alias("k")).agg(F.count_distinct("x.before").alias("n"))
    stock: dict[int, list[int]] = defaultdict(list)
    for r in places.where(f"n >= {least!r}").collect():  # at most the items' sentences
        stock[r.item].append(r.k)

    ids = pa.array([i for i, _ in held], to_arrow_type(items.schema[item_id].dataType))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WuManber(shipped.value) if stock else None
        for batch in batches:
            n_of = batch.column(1).to_pylist()
            found = [*zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            again = [row for row, n in enumerate(n_of) if n in stock and found[row][0] is not None]
            for row in again:
                start, kept, seeds = (batch.column(k)[row].as_py() for k in (6, 9, 10))
                shorter = automaton.without(n_of[row], stock[n_of[row]], kept, seeds)
                found[row] = (shorter[0] + start, *shorter[1:]) if shorter else (None,) * 4
            left = pa.array([row for row, f in enumerate(found) if f[0] is not None], pa.int64())
            values = [pa.array(c, pa.int32()).take(left) for c in (zip(*found) if found else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(left), ids.take(batch.column(1).take(left)), *values], ["doc_id", "item_id", *names[1:5]])

    out = notes.mapInArrow(settle, f"doc_id {_typed('doc_id', docs)}, item_id {_typed(item_id, items)}, doc_word int, item_word int, n_words int, n_changed int")
    if len({i for i, _ in held}) == len(held):
        return out
    best = F.max_by(F.struct("doc_word", "item_word", "n_words", "n_changed"), F.struct("n_words", -F.col("doc_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def leaked_items(leaks: DataFrame) -> DataFrame:
    """For each leaked item, the number of documents that hold it and the longest passage."""
    return leaks.groupBy("item_id").agg(
        F.count("*").alias("n_documents"), F.max("n_words").alias("longest_words"), F.min("n_changed").alias("least_changed")
    )
