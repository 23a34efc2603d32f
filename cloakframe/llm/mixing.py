"""Documents of several sources mixed to target shares of the total token count.

Every document gets its size in tokens of a public tokenizer and a soft
membership in the target domains: a classifier over the same tokens, fitted to
a bounded sample of labelled documents, gives domain posteriors, which are
combined with the document's own source label where it has one; how far labels
are to be trusted is fitted to the held-out part of the sample. Document rates
between zero and the cap are then fitted by projected gradient steps on the
squared error of the expected token totals. A step needs only one sum for each
domain from the documents; rates are a column that is written anew every
``STEPS_PER_CUT`` steps, so nothing but those sums ever leaves the executors.
Rates become whole repeats by a hashed threshold, shifted for each source to
meet its token total; the errors of fit and of rounding are reported.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import collect_bounded, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SAMPLE_PER_SOURCE = 200  # labelled documents read to fit the classifier
HELD_OUT = 5  # every fifth sampled document only tunes the classifier's sharpness
SAMPLE_ROWS = 20_000  # of all sources together
TRUSTS = (0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)  # tried for the probability that a source label is right
MAX_STEPS = 40
STEPS_PER_CUT = 8
TOLERANCE = 1e-4
BINS = 4096
MAX_SOURCES = 1_000


def source_name(source: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.trim(source), "[-\\s_]+", "_")), F.lit(""))


@lru_cache(2)
def _encoding(pattern: str, ranks: bytes):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})


@lru_cache(2)
def tokenizer_spec(path: str) -> tuple[str, bytes]:
    """Pattern and ranks of a public byte-pair encoding, read on the driver and shipped with the job; the pattern is named by the folder's module."""
    import public_tokenizers

    return public_tokenizers.PATTERN, Path(path).read_bytes()


def tokenizer(path: str):
    return _encoding(*tokenizer_spec(path))


def token_ids(path: str, text: str | None) -> np.ndarray:
    return np.array(tokenizer(path).encode_ordinary(text), np.int32) if text else np.zeros(0, np.int32)


class Domains:
    """Multinomial classifier over tokens; ``sharpness`` makes its posteriors honest on held-out documents."""

    def __init__(self, names: list[str], weights: np.ndarray, prior: np.ndarray, sharpness: float, accuracy: float):
        self.names, self.weights, self.prior, self.sharpness, self.accuracy = names, weights, prior, sharpness, accuracy
        self.trust = 0.9

    def labelled(self, p: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Memberships given posteriors and labels (-1 for none), a label being right with probability ``trust``."""
        given = np.full(p.shape, (1 - self.trust) / max(1, p.shape[1] - 1))
        given[np.arange(len(p)), np.maximum(label, 0)] = self.trust
        given[label < 0] = 1.0
        q = (p + 1e-6) * given
        return q / q.sum(1, keepdims=True)

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        z = self.sharpness * scores + self.prior
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def scores(self, ids: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(ids), len(self.names)), np.float32)
        for k, x in enumerate(ids):
            if len(x):
                out[k] = self.weights[x].sum(0)
        return out


def fit_domains(names: list[str], rows: list[tuple[str, str]], path: str) -> Domains:
    n_tokens = tokenizer(path).n_vocab
    data = [(names.index(s), token_ids(path, t)) for s, t in rows if s in names]
    fit, held = [x for i, x in enumerate(data) if i % HELD_OUT], data[::HELD_OUT]
    counts = np.full((n_tokens, len(names)), 0.02, np.float64)
    for k, ids in fit:
        np.add.at(counts[:, k], ids, 1)
    weights = np.log(counts / counts.sum(0)).astype(np.float32)
    weights -= weights.mean(1, keepdims=True)
    n = np.bincount([k for k, _ in fit], minlength=len(names)) + 1.0
    best = Domains(names, weights, np.log(n / n.sum()), 1.0, float("nan"))
    if held:
        # Sharpness and trust together: wrong labels do not blunt the posteriors, they lower the trust.
        scores, truth = best.scores([x for _, x in held]), np.array([k for k, _ in held])
        tried = []
        for best.sharpness in (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.0):
            p = best.posteriors(scores)
            own = p[np.arange(len(truth)), truth]
            other = (1 - own) / max(1, len(names) - 1)
            tried += [(float(np.log(t * own + (1 - t) * other + 1e-12).mean()), t, best.sharpness, float((p.argmax(1) == truth).mean())) for t in TRUSTS]
        _, best.trust, best.sharpness, best.accuracy = max(tried)
    return best


def labelled_sample(documents: DataFrame, names: list[str], per_source: int) -> list[tuple[str, str]]:
    rows = documents.where(F.col("source").isin(names) & (F.length("text") > 0)).withColumn("h", F.xxhash64("doc_id"))
    ranked = rows.select("doc_id", "source", "h").selectExpr("doc_id", "row_number() over (partition by source order by h, doc_id) as rank").where(f"rank <= {per_source}")
    taken = rows.join(F.broadcast(ranked.select("doc_id").distinct()), "doc_id").select("doc_id", "source", "text").collect()
    return [(r.source, r.text) for r in sorted(taken, key=lambda r: r.doc_id)]


def memberships(documents: DataFrame, names: list[str], path: str = TOKENIZER, per_source: int = SAMPLE_PER_SOURCE) -> DataFrame:
    """``doc_id, source, tokens, posterior, membership, key, rate`` of each document; ids keep their type.

    ``posterior`` is the classifier's, from the text alone; ``membership`` adds
    the evidence of the document's own label, right with the fitted probability.
    Null and empty texts have no tokens. ``key`` is a hash of the id, ``rate`` 0.
    """
    docs = documents.select("doc_id", source_name(F.col("source").cast("string")).alias("source"), F.col("text").cast("string").alias("text"))
    domains = fit_domains(names, labelled_sample(docs, names, max(1, min(per_source, SAMPLE_ROWS // len(names)))), path)
    shipped = documents.sparkSession.sparkContext.broadcast((tokenizer_spec(path), domains))  # a row of weights for each token of the vocabulary
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, tokens int, posterior array<float>, membership array<float>, key long, rate double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pattern, ranks), own = shipped.value
        encode = _encoding(pattern, ranks).encode_ordinary
        place = {s: k for k, s in enumerate(names)}
        for batch in batches:
            sizes, scores = [], np.zeros((batch.num_rows, len(names)), np.float32)
            for k, t in enumerate(batch.column(2).to_pylist()):
                ids = np.array(encode(t), np.int32) if t else ()
                sizes.append(len(ids))
                if len(ids):
                    scores[k] = own.weights[ids].sum(0)
            p = own.posteriors(scores)
            q = own.labelled(p, np.array([place.get(s, -1) for s in batch.column(1).to_pylist()], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(list(p.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(q.astype(np.float32)), pa.list_(pa.float32())), batch.column(3), pa.array(np.zeros(batch.num_rows))],
                ["doc_id", "source", "tokens", "posterior", "membership", "key", "rate"],
            )

    return docs.select("doc_id", "source", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("key")).mapInArrow(run, schema)


class Plan:
    """Names, targets and caps of the domains, the gradients since the rates were last written, and each source's threshold shift.

    ``error`` is the largest distance of an expected total from its target over
    the whole, ``n_steps`` the steps taken, ``rounding`` each source's distance
    of the used tokens from the target over that target.
    """

    def __init__(self, names: list[str], share: np.ndarray, cap: np.ndarray):
        self.names, self.share, self.cap = names, share, cap
        self.steps: list[np.ndarray] = []
        self.n_steps, self.error = 0, 0.0
        self.total = 0.0
        self.size = np.zeros(len(names))
        self.shift = np.zeros(len(names))
        self.rounding = np.zeros(len(names))

    def rates(self, r: np.ndarray, q: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Written rates after the steps since; a document's cap is its source's, or its expected one."""
        cap = np.where(source >= 0, self.cap[np.maximum(source, 0)], np.floor(q @ self.cap))
        for g in self.steps:
            r = np.clip(r - q @ g, 0, cap)
        return r


COLUMNS = ("key", "source", "tokens", "membership", "rate")


def _columns(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, ...]:
    """Keys, sources by number, tokens, memberships and written rates of a batch with ``COLUMNS`` first."""
    place = {s: k for k, s in enumerate(names)}
    q = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)).astype(float)
    source = np.array([place.get(s, -1) for s in batch.column(1).to_pylist()], np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False), source, batch.column(2).to_numpy(zero_copy_only=False).astype(float), q, batch.column(4).to_numpy(zero_copy_only=False)


def unit_hash(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def fit_plan(members: DataFrame, names: list[str], share: np.ndarray, cap: np.ndarray, total: float | None = None) -> tuple[Plan, DataFrame]:
    """Projected gradient steps, preconditioned by each domain's size, until every total is within ``TOLERANCE``; with the members and their written rates."""
    plan = Plan(names, share, cap)
    k = len(names)
    rest = ["doc_id", "posterior"]

    def rows() -> DataFrame:
        return members.select(*COLUMNS).where("tokens > 0")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, source, _, q, r = _columns(batch, names)
            yield batch.set_column(4, "rate", pa.array(plan.rates(r, q, source)))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, most, own = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros(k)
        for batch in batches:
            _, source, t, q, r = _columns(batch, names)
            own += np.bincount(np.where(source >= 0, source, q.argmax(1)), t, k)
            out += (plan.rates(r, q, source) * t) @ q
            size += t @ q
            most += (np.where(source >= 0, plan.cap[np.maximum(source, 0)], np.floor(q @ plan.cap)) * t) @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(out), pa.array(size), pa.array(most), pa.array(own)], ["k", "used", "size", "most", "own"])

    def summed() -> np.ndarray:
        found = rows().mapInArrow(totals, "k int, used double, size double, most double, own double").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("used", "size", "most", "own"))).collect()
        out = np.zeros((4, k))
        for r in found:
            out[:, r.k] = r.used, r["size"], r.most, r.own
        return out

    _, plan.size, most, own = summed()
    there = (own > 0) & (share > 0) & (cap > 0)
    plan.share = np.where(there, share, 0) / max(share[there].sum(), 1e-12)
    if not there.any():
        return plan, members
    most = np.minimum(most, own * cap)  # whole repeats are met by each source's own documents
    plan.total = min(float((most[there] / plan.share[there]).min()), total or np.inf)
    want = plan.total * plan.share
    plan.steps.append(-np.where(there, want / np.maximum(plan.size, 1e-9), 0))
    last = np.inf
    for plan.n_steps in range(1, MAX_STEPS + 1):
        if len(plan.steps) > STEPS_PER_CUT:
            kind = members.select(*COLUMNS, *rest).schema
            members = cut(members.select(*COLUMNS, *rest).mapInArrow(written, kind))
            plan.steps = []
        used = summed()[0]
        error = float(np.abs(used - want).max())
        plan.error = error / plan.total
        if error <= TOLERANCE * plan.total:
            break
        if error > 0.7 * last:  # a source is at its caps: the total that the others' memberships promised it is out of reach
            scale = float((used[there] / want[there]).min())
            plan.total, want = plan.total * scale, want * scale
        last = error
        plan.steps.append(np.where(plan.size > 0, (used - want) / np.maximum(plan.size, 1e-9), 0))

    def flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = np.zeros(k), np.zeros((k, BINS))
        for batch in batches:
            ids, source, t, q, r = _columns(batch, names)
            r = plan.rates(r, q, source)
            of = np.where(source >= 0, source, q.argmax(1))
            part = r - np.floor(r)
            np.add.at(base, of, np.floor(r) * t)
            np.add.at(at, (of, np.minimum((np.maximum(unit_hash(ids) - part + 1, 0) / 2 * BINS).astype(int), BINS - 1)), np.where(part > 0, t, 0))
        whole = np.concatenate([base[:, None], at], 1)
        of, slot = np.nonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(slot, pa.int32()), pa.array(whole[of, slot])], ["k", "slot", "t"])

    found = rows().mapInArrow(flips, "k int, slot int, t double").groupBy("k", "slot").agg(F.sum("t").alias("t")).collect()
    whole = np.zeros((k, BINS + 1))
    for r in found:  # at most (sources) x (BINS + 1)
        whole[r.k, r.slot] = r.t
    for s in range(k):
        if plan.share[s] > 0:
            got = np.cumsum(whole[s])
            at = int(np.abs(got - want[s]).argmin())
            plan.shift[s] = at * 2 / BINS - 1
            plan.rounding[s] = abs(got[at] - want[s]) / want[s]
    return plan, members


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, total: float | None = None) -> tuple[DataFrame, Plan]:
    """One row for each document: ``doc_id, source, tokens, rate, repeats, posterior``, and the plan that was fitted.

    ``rate`` is the fitted nonnegative rate, ``repeats`` the whole number of
    times the document is used, never above its source's ``max_repeats``. The
    total is the largest that lets every source reach its share within the
    caps, or ``total`` tokens if that is less. Sources without a document are
    left out of the shares, which are then scaled to one. Documents with a
    missing or unknown source take part by their classifier posteriors. Null
    and empty texts are never used; repeated targets count once (the first by
    share); extra columns are ignored; without targets every rate is zero.
    """
    rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).where("source is not null and share > 0 and cap > 0")
    held = collect_bounded(rows.groupBy("source").agg(F.min(F.struct("share", "cap")).alias("x")).select("source", "x.*"), MAX_SOURCES, "targets")
    held.sort(key=lambda r: r.source)
    names = [r.source for r in held]
    if not names:
        none = documents.select("doc_id", source_name(F.col("source").cast("string")).alias("source"), F.lit(0).alias("tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("repeats"), F.expr("cast(array() as array<float>)").alias("posterior"))
        return none, Plan([], np.zeros(0), np.zeros(0))
    members = cut(memberships(documents, names, path))
    plan, members = fit_plan(members, names, np.array([r.share for r in held]), np.array([r.cap for r in held], float), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source, t, q, r = _columns(batch, names)
            r = np.where(t > 0, plan.rates(r, q, source), 0.0)
            of = np.where(source >= 0, source, q.argmax(1))
            whole, part = np.floor(r), r - np.floor(r)
            slot = np.minimum((np.maximum(unit_hash(ids) - part + 1, 0) / 2 * BINS).astype(int), BINS - 1)
            repeats = (whole + ((part > 0) & (slot < np.round((plan.shift[of] + 1) / 2 * BINS)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(5), batch.column(1), batch.column(2), pa.array(r), pa.array(repeats), batch.column(6)], ["doc_id", "source", "tokens", "rate", "repeats", "posterior"])

    chosen = members.select(*COLUMNS, "doc_id", "posterior").mapInArrow(run, f"doc_id {members.schema['doc_id'].dataType.simpleString()}, source string, tokens int, rate double, repeats int, posterior array<float>")
    return chosen, plan


def reached_shares(chosen: DataFrame, plan: Plan) -> DataFrame:
    """For each target source: wanted and reached share, documents and tokens there and used, the most repeats, and the errors of fit and rounding."""
    rounding = F.create_map(*[F.lit(x) for p in zip(plan.names, map(float, plan.rounding)) for x in p]) if plan.names else F.expr("cast(map() as map<string,double>)")
    known = F.create_map(*[F.lit(x) for p in zip(plan.names, map(float, plan.share)) for x in p]) if plan.names else F.expr("cast(map() as map<string,double>)")
    used = chosen.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("repeats") > 0).alias("n_used"),
        F.sum(F.col("tokens").cast("long")).alias("tokens"),
        F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("used_tokens"),
        F.max("repeats").alias("most_repeats"),
    )
    whole = used.withColumn("total", F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))  # a row for each source
    return whole.select(
        "source", F.element_at(known, F.col("source")).alias("target_share"), F.try_divide("used_tokens", "total").alias("reached_share"),
        "n_documents", "n_used", "tokens", "used_tokens", "most_repeats", F.lit(plan.error).alias("fit_error"), F.element_at(rounding, F.col("source")).alias("rounding_error"),
    )


def mix_checks(chosen: DataFrame, plan: Plan, shares_within: float = 0.005) -> DataFrame:
    """``test, n_violations``: repeats never above the source's cap, rates nonnegative, empty texts unused, and reached shares within ``shares_within`` of the targets."""
    cap = F.create_map(*[F.lit(x) for p in zip(plan.names, map(int, plan.cap)) for x in p])
    most = int(plan.cap.max()) if len(plan.cap) else 0
    over = F.col("repeats") > F.coalesce(F.element_at(cap, F.col("source")), F.lit(most))
    first = chosen.agg(F.count_if(over).alias("cap"), F.count_if(F.col("rate") < 0).alias("nonnegative rate"), F.count_if((F.col("tokens") == 0) & (F.col("repeats") > 0)).alias("empty text"))
    counts = first.select(F.explode(F.create_map(*[x for n in ("cap", "nonnegative rate", "empty text") for x in (F.lit(n), F.col(n))])).alias("test", "n_violations"))
    off = reached_shares(chosen, plan).where("target_share > 0").agg(F.count_if(F.abs(F.col("reached_share") - F.col("target_share")) > shares_within).alias("n_violations"))
    return counts.unionByName(off.select(F.lit("share").alias("test"), "n_violations"))
