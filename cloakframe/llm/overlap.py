"""Same and nearly same records across splits: rarest words, winnowing, alignment.

Texts that share nine tenths of their words share one of the rarest tenth (and
one more) of them, so each different text is listed under these, and the texts
of a word are compared in passing: by length, by rank and by a signature that
bounds how many words are in one of the two only. No pair is lost by that,
however large a family of near copies is, and only pairs that pass are written.

A pair's texts are then reduced to fingerprints: of every window of ``WINDOW``
shingles of ``SHINGLE`` words the least hash is kept, so two texts that share a
run of ``SHINGLE + WINDOW - 1`` words share a fingerprint (texts of fewer than
``SHORT`` words keep every shingle). Shared seeds are chained where both texts
have them in the same order, chains are extended word by word, and what the
chain leaves open is aligned exactly; a chain that falls short of nine tenths is
replaced by the exact alignment of the whole texts.

The texts are written once, packed, and shuffled only for such pairs.
Fingerprints of all texts, with their positions, would take three times the
input's bytes by themselves, and lists of pairs that share a word grow as its
square.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.lookalikes import comparable_words
from cloakframe.llm.splitting import split_name
from cloakframe.session import cut, spread

SHINGLE = 5
WINDOW = 4
SHORT = 40
HOT = 64  # texts of a large family; nothing is left out of one
SAME = 0.9
BUCKETS = 1 << 16
LEAST_BITS, MOST_BITS = 256, 1024
COMPARED = 1 << 19
TOGETHER, PACKED_CHARS = 256, 1 << 20
MAP_BITS = 1 << 22
TRAINING = "devsynth"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words met before; emptied when it holds ``REMEMBERED``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


REMEMBERED = 1 << 18
_HASHES = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, position) of a text's selected shingles."""
    n = len(hashes) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    rolling = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            rolling = rolling * np.uint64(1_099_511_628_211) + hashes[j : n + j]
        rolling = (rolling ^ (rolling >> np.uint64(29))) * _MIX
    if len(hashes) < SHORT or n <= WINDOW:
        at = np.arange(n)
    else:
        windows = np.lib.stride_tricks.sliding_window_view(rolling[::-1], WINDOW)
        at = np.unique(n - 1 - (np.arange(len(windows)) + windows.argmin(1)))  # the rightmost of equal minima
    return rolling[at].view(np.int64), at.astype(np.int32)


def word_tokens(hashes: np.ndarray) -> np.ndarray:
    """A value for each word of a text, the copies of one word having different values."""
    hashes = np.sort(hashes)
    copy = np.arange(len(hashes)) - np.searchsorted(hashes, hashes)
    return hashes ^ copy.astype(np.uint64) * _MIX


def common_in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def chained(a: list, b: list, seeds: list[tuple[int, int]]) -> int:
    """Equal words on the longest collinear chain of seeds, each extended to both sides, plus exact alignment of the gaps."""
    seeds = sorted(set(seeds))
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(seeds)
    for i, (_, p) in enumerate(seeds):
        k = bisect_left(tails, p)
        before[i] = last[k - 1] if k else -1
        tails[k : k + 1] = [p]
        last[k : k + 1] = [i]
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append(seeds[i])
        i = before[i]
    same = ia = ib = 0
    for pa_, pb in reversed(chain):
        if pa_ < ia or pb < ib:
            continue
        lo_a, lo_b = pa_, pb
        while lo_a > ia and lo_b > ib and a[lo_a - 1] == b[lo_b - 1]:
            lo_a, lo_b = lo_a - 1, lo_b - 1
        same += common_in_order(a[ia:lo_a], b[ib:lo_b]) if lo_a > ia and lo_b > ib else 0
        hi_a, hi_b = lo_a, lo_b
        while hi_a < len(a) and hi_b < len(b) and a[hi_a] == b[hi_b]:
            hi_a, hi_b = hi_a + 1, hi_b + 1
        same += hi_a - lo_a
        ia, ib = hi_a, hi_b
    return same + (common_in_order(a[ia:], b[ib:]) if ia < len(a) and ib < len(b) else 0)


def _records(records: DataFrame, key: str, text: str, split: str, source: str) -> DataFrame:
    return records.select(
        F.col(key).cast("string").alias("id"),
        split_name(F.col(split), F.col(key).cast("string")).alias("split"),
        F.lower(F.regexp_replace(F.trim(F.col(source).cast("string")), "[-\\s]+", "_")).alias("source"),
        F.col(text).alias("text"),
    ).where("id is not null and split is not null and text is not null")


def class_table(rows: DataFrame, training: str = TRAINING) -> DataFrame:
    """``id, split, source, tid, n_words`` of records; ``tid`` is the same for equal words.

    Besides, without an ``id``, rows with the texts of up to ``TOGETHER`` records
    (``tids``, ``evaluations``; their words in ``packed``, of ``size`` bytes when
    unpacked) and a row for each part that has only ``counts``: how many of its
    words (with their copies) fall into each of ``BUCKETS``.
    """
    kinds = {"id": pa.string(), "split": pa.string(), "source": pa.string(), "tid": pa.int64(), "n_words": pa.int32(), "tids": pa.binary(), "evaluations": pa.binary(), "size": pa.int32(), "packed": pa.binary(), "counts": pa.binary()}

    def made(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, kind)) for k, kind in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            evaluations = np.array([x != training for x in batch.column(1).to_pylist()])
            tids, sizes, lines, chars, tokens = [], [], [], 0, []

            def packed(last: int) -> pa.RecordBatch:
                own = slice(last - len(lines), last)
                text = "\n".join(lines).encode()
                return made(
                    tids=pa.array([np.array(tids[own], np.int64).tobytes()]), evaluations=pa.array([evaluations[own].tobytes()]),
                    size=pa.array([len(text)], pa.int32()), packed=pa.array([pa.compress(text, "zstd", asbytes=True)]),
                )

            for k, t in enumerate(batch.column(3).to_pylist()):
                words = comparable_words(t)
                joined = " ".join(words)
                tids.append(xxhash.xxh3_64_intdigest(joined) - (1 << 63))
                sizes.append(len(words))
                lines.append(joined)
                chars += len(joined)
                tokens.append(word_tokens(word_hashes(words)))
                if len(lines) == TOGETHER or chars > PACKED_CHARS or k == batch.num_rows - 1:
                    total += np.bincount((np.concatenate(tokens) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                    yield packed(k + 1)
                    lines, chars, tokens = [], 0, []
            yield made(**{k: batch.column(i) for i, k in enumerate(("id", "split", "source"))}, tid=pa.array(tids, pa.int64()), n_words=pa.array(sizes, pa.int32()))
        if total.any():
            yield made(counts=pa.array([zlib.compress(total.tobytes(), 1)]))

    return rows.mapInArrow(run, "id string, split string, source string, tid long, n_words int, tids binary, evaluations binary, size int, packed binary, counts binary")


def _packed(prepared: DataFrame) -> DataFrame:
    return prepared.where("packed is not null").select("tids", "evaluations", "size", "packed")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """The classes, kinds and words of each row of ``_packed``."""
    for batch in batches:
        for r in range(batch.num_rows):
            tids, evaluations, size, packed = (batch.column(k)[r].as_py() for k in range(4))
            lines = pa.decompress(packed, size, "zstd", asbytes=True).decode().split("\n")
            yield np.frombuffer(tids, np.int64), np.frombuffer(evaluations, bool), lines


def token_counts(prepared: DataFrame) -> np.ndarray:
    """The sum of the parts' counts: how many words of all records fall into each of ``BUCKETS``, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                n += np.frombuffer(zlib.decompress(packed), np.int64)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    parts = prepared.where("counts is not null").select("counts").coalesce(prepared.sparkSession.sparkContext.defaultParallelism)
    for r in parts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def signature_bits(n: int) -> int:
    """Bits of the signature of a text of ``n`` words: half as many as words, a power of two."""
    bits = LEAST_BITS
    while bits < n // 2 and bits < MOST_BITS:
        bits *= 2
    return bits


def signature(tokens: np.ndarray) -> bytes:
    """For each residue whether an odd number of tokens has it. Two texts' signatures differ in no more bits than tokens are in one text only."""
    bits = signature_bits(len(tokens))
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix_table(prepared: DataFrame, counts: np.ndarray) -> DataFrame:
    """``token, n_words, rank, evaluation, tid, signature`` of each record's rarest tenth (and one more) of words.

    Rarity is that of a word's bucket, ties by the token: one order for all
    texts, which is all that the prefix filter needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tids, evaluations, lines in _unpacked(batches):
            first, many, lengths, signatures = [], [], [], []
            for line in lines:
                tokens = word_tokens(word_hashes(line.split(" ") if line else []))
                order = np.lexsort((tokens, counts[(tokens % np.uint64(BUCKETS)).astype(np.int64)]))
                first.append(tokens[order[: int(len(tokens) * (1 - SAME) + 1e-9) + 1]])
                many.append(len(first[-1]))
                lengths.append(len(tokens))
                signatures.append(signature(tokens))
            row = np.repeat(np.arange(len(lines)), many)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + 1
            columns = [
                pa.array(np.concatenate(first).view(np.int64)), pa.array(np.array(lengths, np.int32)[row]), pa.array(rank.astype(np.int32)),
                pa.array(evaluations[row]), pa.array(tids[row]), pa.array(signatures, pa.binary()).take(pa.array(row)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["token", "n_words", "rank", "evaluation", "tid", "signature"])

    return _packed(prepared).mapInArrow(run, "token long, n_words int, rank int, evaluation boolean, tid long, signature binary")


def _folded(signatures: np.ndarray, bits: int) -> np.ndarray:
    """Signatures (one a column) for fewer bits, which are those of the tokens' residues by that number."""
    while len(signatures) > bits // 64:
        half = len(signatures) // 2
        signatures = signatures[:half] ^ signatures[half:]
    return signatures


def _near(run: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray, sig_one: np.ndarray, sig_two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs from two lists of rows, both by run and n, that have one run, lengths within nine tenths and signatures as near as pairs of nine tenths have them; and by how many bits these differ."""
    key = run[two] << 32 | n[two]
    lo = np.searchsorted(key, run[one] << 32 | np.ceil(n[one] * SAME - 1e-9).astype(np.int64))
    hi = np.searchsorted(key, run[one] << 32 | np.floor(n[one] / SAME + 1e-6).astype(np.int64), "right")
    # Whatever the other's length, so many words at most are in one of the two only.
    apart = np.floor(2 * (1 - SAME) * n[one] + 1e-6).astype(np.int64)
    some = np.nonzero(hi > lo)[0]
    ends = np.cumsum(hi[some] - lo[some])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        rows = some[at:to]
        many = hi[rows] - lo[rows]
        i = np.repeat(rows, many)
        j = np.arange(len(i)) + np.repeat(lo[rows] - np.cumsum(many) + many, many)
        differ = np.zeros(len(i), np.int64)
        for k in range(0, len(sig_one), 2):
            differ += np.bitwise_count(sig_one[k][i] ^ sig_two[k][j])
            differ += np.bitwise_count(sig_one[k + 1][i] ^ sig_two[k + 1][j])
            keep = np.nonzero(differ <= apart[i])[0]
            i, j, differ = i[keep], j[keep], differ[keep]
        yield one[i], two[j], differ
        at = to


def near_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of rows of ``prefix_table``, by token and ``n_words``, that pass every filter; a pair may come repeatedly.

    Of a token's rows those are kept from batch to batch whose length can still
    match one that follows.
    """
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if kept is None else pa.concat_batches([kept, batch])
        old = rows.num_rows - batch.num_rows
        token, n, rank, tid = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2, 4))
        evaluation = rows.column(3).to_numpy(zero_copy_only=False).astype(bool)
        run = np.cumsum(np.r_[False, token[1:] != token[:-1]])
        again = np.r_[False, (token[1:] == token[:-1]) & (tid[1:] == tid[:-1]) & (evaluation[1:] == evaluation[:-1])]
        new = np.arange(rows.num_rows) >= old
        size = np.diff(np.frombuffer(rows.column(5).buffers()[1], np.int32, rows.num_rows + 1, 4 * rows.column(5).offset))
        widths = {}
        for width in np.unique(size).tolist():
            at = np.nonzero((size == width) & ~again)[0]
            packed = b"".join(rows.column(5).take(pa.array(at)).to_pylist())
            widths[width] = at, np.ascontiguousarray(np.frombuffer(packed, np.uint64).reshape(len(at), width // 8).T)
        found = [np.zeros((2, 0), np.int64)]
        for w1, (at1, s1) in widths.items():
            for w2, (at2, s2) in widths.items():
                if max(w1, w2) > 2 * min(w1, w2):
                    continue  # lengths too different
                f1, f2 = (_folded(s, 8 * min(w1, w2)) for s in (s1, s2))
                for one, two in ((evaluation & new, ~evaluation), (evaluation & ~new, ~evaluation & new)):
                    x, y = one[at1], two[at2]
                    for i, j, differ in _near(run, n, at1[x], at2[y], f1[:, x], f2[:, y]):
                        need = np.ceil(np.maximum(n[i], n[j]) * SAME - 1e-9)
                        # Before the first word that both prefixes hold, a text has nothing of what the two share.
                        ok = (tid[i] != tid[j]) & (np.minimum(n[i] - rank[i], n[j] - rank[j]) + 1 >= need) & (differ <= n[i] + n[j] - 2 * need)
                        found.append(np.stack([tid[i[ok]], tid[j[ok]]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
        start = int(np.searchsorted(run, run[-1]))
        kept = rows.slice(start + int(np.searchsorted(n[start:], np.ceil(n[-1] * SAME - 1e-9))))


def needed_texts(prepared: DataFrame, candidates: DataFrame) -> DataFrame:
    """``tid, words`` of every class of the candidates; there may be others.

    Classes that no candidate has are left out by a bit map of fixed size, which
    passes some of them, before anything is shuffled.
    """
    tids = candidates.select(F.col("a").alias("tid")).unionByName(candidates.select(F.col("b").alias("tid")))
    bits = tids.groupBy(F.expr(f"cast(pmod(tid, {MAP_BITS}) div 32 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(tid, 32) as int)))").alias("bits"))
    known = np.zeros(MAP_BITS // 32, np.uint32)
    for r in bits.collect():
        known[r["at"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tids, _, lines in _unpacked(batches):
            bit = tids % MAP_BITS
            hit = np.nonzero(known[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array(tids[hit]), pa.array([lines[k] for k in hit], pa.string())], ["tid", "words"])

    return _packed(prepared).mapInArrow(run, "tid long, words string").dropDuplicates(["tid"])


def seeds_of(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Positions of the fingerprints that both texts have, once each."""
    (fa, at_a), (fb, at_b) = (fingerprints(word_hashes(w)) for w in (x, y))
    (fa, ia, na), (fb, ib, nb) = (np.unique(f, return_index=True, return_counts=True) for f in (fa, fb))
    _, i, j = np.intersect1d(fa[na == 1], fb[nb == 1], assume_unique=True, return_indices=True)
    return list(zip(at_a[ia[na == 1][i]].tolist(), at_b[ib[nb == 1][j]].tolist()))


def words_in_order(x: list[str], y: list[str]) -> int:
    """Equal words of two texts in order, from their chain of seeds where that has nine tenths, else exactly; 0 if they cannot have nine tenths."""
    enough = SAME * max(len(x), len(y)) - 1e-9
    if len(np.intersect1d(word_tokens(word_hashes(x)), word_tokens(word_hashes(y)), assume_unique=True)) < enough:
        return 0
    seeds = seeds_of(x, y)
    same = chained(x, y, seeds) if seeds else 0
    return same if same >= enough else common_in_order(x, y)


def text_pairs(prepared: DataFrame) -> DataFrame:
    """Pairs of different texts, the first with evaluation and the second with training records: ``a, b, same, n_a, n_b``."""
    prefixes = spread(prefix_table(prepared, token_counts(prepared)), "token").sortWithinPartitions("token", "n_words", "tid", "evaluation")
    candidates = cut(prefixes.mapInArrow(near_texts, "a long, b long").distinct())
    texts = cut(needed_texts(prepared, candidates))
    # Neither the texts nor the candidates have a size bound, so these joins never broadcast.
    one, two = (texts.select(F.col("tid").alias(k), F.col("words").alias(f"words_{k}")).hint("merge") for k in "ab")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[w.split(" ") for w in batch.column(k).to_pylist()] for k in (2, 3)]
            columns = [pa.array(list(map(words_in_order, *sides)), pa.int32()), *(pa.array(list(map(len, side)), pa.int32()) for side in sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "same", "n_a", "n_b"])

    full = candidates.join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b")
    return full.mapInArrow(align, "a long, b long, same int, n_a int, n_b int").where(f"same >= {SAME} * greatest(n_a, n_b) - 1e-9")


def cross_split_overlaps(records: DataFrame, training: str = TRAINING, key: str = "id", text: str = "text", split: str = "split", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the overlaps between training and evaluation records.

    ``members``: ``id, split, source, tid``, each record with its text class.
    ``pairs``: ``a, b, same, n_a, n_b``, classes of an evaluation and a training
    text with at least nine tenths of the longer one's words equal in order, a
    class with both kinds of records being paired with itself. Letter case,
    spacing and look-alikes do not count. Redelivered records count once, null
    keys, splits and texts and texts without words are left out, extra columns
    are ignored.
    """
    prepared = cut(class_table(_records(records, key, text, split, source), training))
    members = prepared.where("n_words > 0").select("id", "split", "source", "tid").distinct()
    both = prepared.where("n_words > 0").groupBy("tid").agg(F.max(F.col("split") != training).alias("e"), F.max(F.col("split") == training).alias("t"), F.max("n_words").alias("n"))
    equal = both.where("e and t").select(F.col("tid").alias("a"), F.col("tid").alias("b"), F.col("n").alias("same"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return members, text_pairs(prepared).unionByName(equal)


def record_pairs(members: DataFrame, pairs: DataFrame, training: str = TRAINING) -> DataFrame:
    """Each pair of one evaluation and one training record: ``id_a, id_b, coverage``, ``id_a < id_b``."""
    e = members.where(F.col("split") != training).select(F.col("id").alias("x"), F.col("tid").alias("a"))
    t = members.where(F.col("split") == training).select(F.col("id").alias("y"), F.col("tid").alias("b"))
    coverage = F.round(F.col("same") / F.greatest("n_a", "n_b"), 6)
    rows = pairs.join(e.hint("merge"), "a").join(t.hint("merge"), "b").where("x <> y")
    return rows.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), coverage.alias("coverage")).distinct()


def overlap_report(members: DataFrame, pairs: DataFrame, training: str = TRAINING) -> DataFrame:
    """For each split and source: records, records with a partner in the other kind of split, and their mean best coverage."""
    best = (
        pairs.select(F.col("a").alias("tid"), F.lit(True).alias("e"), (F.col("same") / F.col("n_a")).alias("c"))
        .unionByName(pairs.select(F.col("b").alias("tid"), F.lit(False).alias("e"), (F.col("same") / F.col("n_b")).alias("c")))
        .groupBy("tid", "e").agg(F.max("c").alias("c"))
    )
    rows = members.withColumn("e", F.col("split") != training).join(best.hint("merge"), ["tid", "e"], "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("c").alias("n_overlapping"), F.round(F.avg("c"), 6).alias("mean_coverage"))
