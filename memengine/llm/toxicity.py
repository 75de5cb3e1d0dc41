"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

A text is cut into segments: its words without ASCII signs ("i.d.i.o.t"), letters set apart by single
spaces ("i d i o t") as one segment, and overlapping stretches of very long words.  The kernel of two segments
counts the subsequences of four symbols that they share, each weighted by
DECAY to the power of the stretch it spans in either (up to SPAN symbols), over
the norms of the two: gaps and inserted characters lower it, but don't break it.

The machine is trained on labelled texts.  A text's label is that of its worst
segment, so training starts from segments with pieces that toxic texts hold far
more often, by a test of significance (and gapped copies of them; without any such piece, each toxic
text's most telling segment, chosen again by the machine in each round), against segments of harmless texts, fits, and adds
the highest segment of each harmless text, in rounds.  Segments are described by
their kernels with a few landmark segments, whitened by the landmarks' kernels
(Nystroem); the machine is linear there.  Because the kernel is an inner product
over subsequences, the landmarks' weights collapse into one table of 40**4
numbers (10 MB), and a text is scored in one pass over its bytes.  The sample is
bounded: at most MAX_ROWS labelled texts and MAX_BYTES bytes, half of either
label where there are enough, chosen by the hash of the id.

Defined results: null and empty texts and texts of white space only have no
segment and get the score of a harmless one; without labels of both kinds, or
without any segment in the toxic texts, every score is 0; an id labelled more than once counts as toxic if any label says so;
rows without an id are scored but never trained on; labels other than 0 and 1 are ignored; a
very long text is scored whole, in one pass; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.llm.blocks import to_arrow_schema
from memengine.llm.common import held, only, sampled, table
from memengine.llm.textops import LOWER, SPACE, pieces, utf8

MAX_ROWS, MAX_BYTES = 4000, 24 << 20
LANDMARKS, ALIKE = 120, 0.75
DECAY, SPAN, LONG = 0.85, 8, 24
ROUNDS = 3
#: Bounds of the fit, whatever the sample: harmless segments drawn, those of them that get gapped copies, and candidates for landmarks of either kind.
NEGATIVES, GAPPED_NEGATIVES, LEADING, PLAIN = 5000, 2500, 600, 300
#: Of the machine's weights, beside costs that add up to one for each kind of segment.
PENALTY = 1e-2
#: Copies of each suspicious segment with characters inserted, that the machine is trained on as well.
COPIES = 4
#: A false alarm weighs as much as so many misses where the boundary is set.
ALARM = 2.0
#: Hashes by which near copies in the sample are told.
SKETCH = 16
#: A piece of a word is suspicious if it stands in so many toxic texts, and by this log ratio more often than in others.
ENOUGH, SUSPICIOUS = 4, 3.5
#: And if its log-likelihood ratio, copies counted once, is no smaller (chance 1 in 10,000 for one piece).
SIGNIFICANT = 15.1
#: Of the curve from margins to scores.
SLOPE = 2.0

#: 40 symbols: white space, letters, a digit, other ASCII, the start of a segment, and classes of the bytes above ASCII.
SYMBOLS, GAP, EDGE = 40, 28, 29
CODES = np.full(256, GAP, dtype=np.int32)
CODES[SPACE] = 0
CODES[0x61:0x7B] = np.arange(1, 27)
CODES[0x30:0x3A] = 27
CODES[0x80:0xC0] = 30 + np.arange(64) % 9
CODES[0xC0:] = 39
_STEPS = [(d, e, f) for d in range(1, SPAN) for e in range(1, SPAN - d) for f in range(1, SPAN - d - e)]


def _norms() -> np.ndarray:
    """Root of the summed squared weights of all subsequences, by length of the segment."""
    out = np.ones(LONG + 1)
    for n in range(4, LONG + 1):
        out[n] = np.sqrt(sum((n - sum(step)) * DECAY ** (2 * (sum(step) + 1)) for step in _STEPS if sum(step) < n))
    return out


NORMS = _norms()


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, segment starts, segment ends, offsets, bytes) of the texts, each behind a space and without ASCII signs; a segment starts with EDGE."""
    texts = len(offsets) - 1
    padded = np.full(len(data) + texts, 0x20, dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))] = data
    offsets = offsets + np.arange(texts + 1)
    padded = LOWER[padded]
    codes = CODES[padded]

    def without_signs() -> None:
        nonlocal codes, padded, offsets
        keep = codes != GAP
        offsets = np.append(0, np.cumsum(keep))[offsets]
        codes, padded = codes[keep], padded[keep]

    def cut() -> tuple[np.ndarray, np.ndarray]:
        solid = np.append(codes > 0, False)
        return np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:]) + 1

    without_signs()
    starts, ends = cut()  # starts: the space before
    single = (ends - starts == 2) & (codes[starts + 1] <= 27)
    join = np.flatnonzero(single[1:] & single[:-1] & (starts[1:] == ends[:-1])) + 1
    if len(join):
        join = join[~np.isin(starts[join], offsets[:-1])]
        codes[starts[join]] = GAP
        without_signs()
        starts, ends = cut()
    codes[starts] = EDGE
    return codes, starts, ends, offsets, padded


def _spread(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each position the weighted sum of `weights` over the subsequences of its segment that begin there."""
    n = len(codes)
    length = ends - starts
    rest = np.zeros(n, dtype=np.int8)  # symbols of the segment after this one, as far as a subsequence reaches
    where = np.repeat(starts, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    rest[where] = np.minimum(np.repeat(ends, length) - where - 1, SPAN)
    out = np.zeros(n, dtype=np.float32)
    places = [codes * SYMBOLS**3, codes * SYMBOLS**2, codes * SYMBOLS, codes]
    for d in range(1, SPAN):
        at = np.flatnonzero(rest >= d + 2)  # those from which a fourth symbol can still be reached
        one = places[0][at] + places[1][at + d]
        for e in range(1, SPAN - d):
            go = rest[at] >= d + e + 1
            at, one = at[go], one[go]
            two = one + places[2][at + d + e]
            for f in range(1, SPAN - d - e):
                ok = rest[at] >= d + e + f
                if not ok.any():
                    break
                to = at[ok]
                out[to] += weights[two[ok] + codes[to + (d + e + f)]] * np.float32(DECAY ** (d + e + f + 1))
    return out


def kernel_sums(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The inner product of each segment with `weights`, over the segment's norm; a long one's highest over its stretches."""
    if not len(starts):
        return np.zeros(0)
    at = _spread(codes, starts, ends, weights)
    length = ends - starts
    out = np.add.reduceat(np.append(at, np.float32(0)), np.stack([starts, ends], axis=1).ravel())[::2].astype(float)
    short = length <= LONG
    out[short] /= NORMS[length[short]]
    for i in np.flatnonzero(~short).tolist():
        own = np.append(0, np.cumsum(at[starts[i] : ends[i]], dtype=float))
        a = np.arange(0, length[i], LONG // 2)
        out[i] = (own[np.minimum(a + LONG, length[i])] - own[a]).max() / NORMS[LONG]
    return out


def subsequences(segment: bytes) -> Counter:
    """Weight of each subsequence (as its place in the table) of one segment, over its norm."""
    codes = [EDGE, *[c for c in CODES[LOWER[np.frombuffer(segment, dtype=np.uint8)]].tolist() if c != GAP][: LONG - 1]]
    out: Counter = Counter()
    for d, e, f in _STEPS:
        for i in range(len(codes) - d - e - f):
            out[((codes[i] * SYMBOLS + codes[i + d]) * SYMBOLS + codes[i + d + e]) * SYMBOLS + codes[i + d + e + f]] += DECAY ** (d + e + f + 1)
    return Counter({u: w / NORMS[min(len(codes), LONG)] for u, w in out.items()})


class Machine:
    """A table over subsequences, its offset, and the curve from a text's highest value to a probability."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest value of each text's segments; that of an empty segment if there is none."""
        codes, starts, ends, offsets, _ = segments(data, offsets)
        values = kernel_sums(codes, starts, ends, self.weights) + self.offset
        of = np.searchsorted(starts, offsets)
        out = np.full(len(offsets) - 1, self.offset)
        some = of[1:] > of[:-1]
        if some.any():
            out[some] = np.maximum.reduceat(values, of[:-1][some])
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.shift, -50, 50)))


def _linear(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = PENALTY, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge), by Newton steps on the rows inside the margin."""
    x1 = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], penalty), 1e-9)

    def loss(w: np.ndarray) -> float:
        return float((cost * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum() + (ridge * w * w).sum())

    w = np.zeros(x1.shape[1])
    now = loss(w)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ w))
        inside = slack > 0
        gradient = -2 * x1.T @ (cost * y * slack) + 2 * ridge * w
        curve = 2 * (x1[inside] * cost[inside, None]).T @ x1[inside] + 2 * np.diag(ridge)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-9 * (1 + now):
            break
        w, now = w - size * step, then
    return w[:-1], float(w[-1])


def _own_segments(text: bytes) -> list[bytes]:
    _, starts, ends, _, padded = segments(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    raw = padded.tobytes()
    return list(dict.fromkeys(raw[a + 1 : b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 3))


def _laid_out(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends) with each of the segments behind an edge of its own."""
    raw = np.frombuffer(b" " + b" ".join(own), dtype=np.uint8)
    starts = np.append(0, np.cumsum([len(s) + 1 for s in own])[:-1])
    codes = CODES[LOWER[raw]]
    codes[codes == 0] = GAP
    codes[starts] = EDGE
    keep = codes != GAP
    codes = codes[keep]
    starts = np.append(0, np.cumsum(keep))[starts]
    return codes, starts, np.append(starts[1:], len(codes))


def _gapped(segment: bytes, rng: np.random.Generator) -> bytes:
    """The segment with one or more characters inserted between its letters: strange ones, or the letter again."""
    fill = b"xeq0i1azk"
    again, every = rng.random() < 0.3, rng.random() < 0.25
    places = [i for i, c in enumerate(segment) if c < 0x80 and i + 1 < len(segment)]
    chosen = set(places if every else [i for i in places if rng.random() < 0.25] or (places and [places[int(rng.integers(0, len(places)))]]))
    mark = fill[int(rng.integers(0, len(fill)))]
    out = bytearray()
    for i, c in enumerate(segment):
        out.append(c)
        if i in chosen:
            out.append(c if again else mark)
    return bytes(out)


def _without_copies(bags: list[tuple]) -> list[tuple]:
    """One of each group of near copies with the same label: those that share half of their SKETCH smallest hashes with an earlier text."""
    holders: dict[tuple, list[int]] = defaultdict(list)
    out = []
    for own, y, text in bags:
        sketch = sorted({zlib.crc32(s) for s in own})[:SKETCH]
        shared = Counter(i for h in sketch for i in holders[y, h])
        if not sketch or max(shared.values(), default=0) * 2 < len(sketch):
            out.append((own, y, text))
            for h in sketch:
                holders[y, h].append(len(out))
    return out


def fit(texts: list[bytes], toxic: list[int], ratio: float = 1.0, seed: int = 3) -> Machine | None:
    """Train on labelled texts; ratio: how many harmless texts stand for each harmless one of the sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(texts))
    bags = [(_own_segments(texts[i]), toxic[i], texts[i]) for i in order]
    part = len(bags) * 7 // 10
    training, checks = bags[:part], bags[part:]
    if len({y for own, y, _ in training if own or not y}) < 2:
        training = bags
    if len({y for own, y, _ in training if own or not y}) < 2:
        return None

    def pieces_of(s: bytes) -> set[bytes]:
        s = b"^" + s
        return {s[i : i + k] for k in (4, 5, 6, 7) for i in range(len(s) - k + 1)}

    training = _without_copies(training)  # copies of one text are no further evidence
    seen, texts_of = {0: Counter(), 1: Counter()}, {y: sum(kind == y for _, kind, _ in training) for y in (0, 1)}
    for own, y, _ in training:
        seen[y].update({g for s in own for g in pieces_of(s)})
    share = texts_of[0] / texts_of[1]
    every_odds = {g: np.log((c * share + 0.5) / (seen[0][g] + 0.5)) for g, c in seen[1].items()}

    def evidence(g: bytes) -> float:
        """Log-likelihood ratio of the piece's counts in toxic and harmless texts."""
        rate = (seen[0][g] + seen[1][g]) / (texts_of[0] + texts_of[1])
        out = 0.0
        for y in (0, 1):
            for n, expected in ((seen[y][g], texts_of[y] * rate), (texts_of[y] - seen[y][g], texts_of[y] * (1 - rate))):
                out += 2 * n * np.log(n / expected) if n else 0.0
        return out

    odds = {g: value for g, value in every_odds.items() if seen[1][g] >= ENOUGH and value > SUSPICIOUS and evidence(g) >= SIGNIFICANT}

    def suspicion(s: bytes) -> tuple[float, int, bytes]:
        return max(((odds[g], seen[1][g], g) for g in pieces_of(s) if g in odds), default=(-9.0, 0, b""))

    found_bad, groups = Counter(), defaultdict(Counter)
    for own, y, _ in training:
        for s in own if y else ():
            value, _, gram = suspicion(s)
            if value > SUSPICIOUS:
                found_bad[s] += 1
                groups[gram][s] += 1
    harmless = Counter(s for own, y, _ in training if not y for s in own)
    worst = [s for s in found_bad if not harmless[s]]
    groups = {g: c for g, own in groups.items() if (c := Counter({s: n for s, n in own.items() if not harmless[s]}))}
    as_bags = not worst
    if as_bags:

        def telling(s: bytes) -> tuple[float, bytes]:
            return max((every_odds.get(g, 0.0), g) for g in pieces_of(s))

        for own, y, _ in training:
            if y and own:
                s = max(own, key=lambda s: (not harmless[s], telling(s)))
                found_bad[s] += 1
                groups.setdefault(telling(s)[1], Counter())[s] += 1
        worst = list(found_bad)
    known = sorted(harmless) or [b""]
    negatives = [known[i] for i in rng.integers(0, len(known), NEGATIVES).tolist()]
    maps: list[Counter] = []

    def add(candidates: list[bytes], most: int) -> None:
        """Take those that are unlike what is taken already."""
        for s in candidates:
            if len(maps) < most and all(sum(w * m[u] for u, w in own.items() if u in m) < ALIKE for own in [subsequences(s)] for m in maps):
                maps.append(subsequences(s))

    by_group = sorted(groups.values(), key=lambda c: (-sum(c.values()), min(c)))
    leading = [s for i in range(6) for c in by_group for s, _ in c.most_common(i + 1)[i:]][:LEADING]
    add([t for s in leading for t in (s, _gapped(s, rng))], LANDMARKS * 2 // 3)
    add(negatives[:PLAIN], LANDMARKS)
    base = np.array([[sum(w * b[u] for u, w in a.items() if u in b) for b in maps] for a in maps])
    values, vectors = np.linalg.eigh(base)
    whiten = vectors @ np.diag(np.where(values > 1e-4, 1 / np.sqrt(np.maximum(values, 1e-4)), 0)) @ vectors.T

    def describe(own: list[bytes]) -> np.ndarray:
        laid, out, dense = _laid_out(own), [], np.zeros(SYMBOLS**4, dtype=np.float32)
        for m in maps:
            dense[list(m)] = list(m.values())
            out.append(kernel_sums(*laid, dense))
            dense[list(m)] = 0
        return np.stack(out, axis=1) @ whiten

    def positives() -> tuple[np.ndarray, np.ndarray]:
        times = np.array([found_bad[s] for s in worst], dtype=float)
        return describe(worst + [_gapped(s, rng) for _ in range(COPIES) for s in worst]), np.append(times, np.tile(times, COPIES) / COPIES) / (2 * times.sum())

    def highest(kind: int, weights: np.ndarray) -> list[bytes]:
        """The highest segment of each training text of this kind."""
        own_of = [own for own, y, _ in training if y == kind and own]
        every = [s for own in own_of for s in own]
        at = np.append(0, np.cumsum([len(own) for own in own_of]))
        found = kernel_sums(*_laid_out(every), weights) if every else np.zeros(0)
        return [every[a + int(found[a:b].argmax())] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    bad_x, times = positives()
    negative_x = describe(negatives + [_gapped(s, rng) for s in negatives[:GAPPED_NEGATIVES]])
    machine, hard = None, []
    hard_x = np.zeros((0, len(maps)))
    for _ in range(ROUNDS):
        x = np.concatenate([bad_x, negative_x, hard_x])
        y = np.append(np.ones(len(bad_x)), -np.ones(len(negative_x) + len(hard_x)))
        w, offset = _linear(x, y, np.concatenate([times, np.full(len(negative_x), 1 / len(negative_x)), np.full(len(hard_x), 1 / max(1, len(hard_x)))]))
        weights = np.zeros(SYMBOLS**4, dtype=np.float32)
        for share_of, m in zip(whiten @ w, maps, strict=True):
            weights[list(m)] += np.array(list(m.values()), dtype=np.float32) * np.float32(share_of)
        machine = Machine(weights, offset)
        fresh = sorted(set(highest(0, weights)) - set(hard))
        if as_bags:
            found_bad = Counter(highest(1, weights))
            worst = list(found_bad)
            bad_x, times = positives()
        hard += fresh
        if fresh:
            hard_x = np.concatenate([hard_x, describe(fresh)])
    judged = _without_copies(checks) if len({y for _, y, _ in checks}) > 1 else training
    offsets = np.append(0, np.cumsum([len(t) for _, _, t in judged]))
    margin = machine.margins(np.frombuffer(b"".join(t for _, _, t in judged), dtype=np.uint8), offsets)
    y = np.array([y for _, y, _ in judged], dtype=float)
    # Labels that no segment explains would flatten a logistic curve: the boundary is where the weighted errors are fewest.
    at = np.unique(margin)
    bounds = np.append(at[:1] - 1, np.append((at[1:] + at[:-1]) / 2, at[-1:] + 1))
    errors = np.array([np.where(y > 0, margin < c, ALARM * ratio * (margin >= c)).sum() for c in bounds])
    best = np.flatnonzero(errors == errors.min())
    machine.slope = SLOPE
    machine.shift = -SLOPE * float(bounds[best[len(best) // 2]])
    return machine


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Machine | None:
    """A machine from rows (id, text) that have labels (id, toxic)."""
    marked = labels.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {x["toxic"]: x["n"] for x in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    share = F.when(F.col("toxic") == 1, max_rows / 2 / sizes[1]).otherwise(max_rows / 2 / sizes[0])
    chosen = marked.where(F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(1 << 30)) / float(1 << 30) < share).orderBy("id").limit(2 * max_rows)
    labelled = docs.join(F.broadcast(chosen), "id").select("id", F.col("text").cast("binary").alias("text"), "toxic").where("length(text) > 0")
    rows = sampled(labelled, 5, 2 * max_rows, max_bytes)
    texts, toxic = [bytes(x["text"]) for x in rows], [int(x["toxic"]) for x in rows]
    taken = {y: min(1.0, max_rows / 2 / n) for y, n in sizes.items()}
    return fit(texts, toxic, taken[1] / taken[0]) if texts else None


def score(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # 40**4 numbers
    added = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in dict(added)] + [T.StructField(n, t) for n, t in added])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            names = batch.schema.names
            data, offsets = utf8(batch.column(names.index(text_col)))
            for a, b in pieces(offsets):
                found = own.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if own else np.zeros(b - a)
                columns = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(names)}
                columns |= {"score": pa.array(found), "predicted": pa.array((found >= 0.5).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in kind], schema=kind)

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), id="doc_id", text="text").withColumn("held_out", held("id", 5, 0))
    labels = only(table(spark, sf_dir, "labels"), id="doc_id", toxic="toxic").where(~held("id", 5, 0))
    machine = train(docs.where("NOT held_out").select("id", "text"), labels)
    return score(docs, machine).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
