"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its n-grams of two, three and four bytes (letters A-Z in
lower case, a space before and after the text), hashed into buckets that have an
embedding each; the average goes through a linear softmax.  Both are trained by
stochastic gradient descent in numpy, on a bounded sample: at most about
MAX_ROWS texts, the same number for each language, chosen by the hash of the
id, each as a whole and as four short pieces.  As the model is linear in the
buckets, a text is scored by averaging one number for each bucket and language.

Part of the sample is kept from training: it sets the softmax's temperature and
the least score at which predictions of the sample are right as often as
TARGET; below it `confident` is false (calibrated rejection).

Defined results: null texts and texts without any letter are `und` with score
0 and never confident; without training rows everything is `und`; rows with a null lang are
predicted, not learned; a null id is in the training part; rows of equal id and text are
learned once; of more than MAX_ROWS languages the rarest aren't learned; a very long text is scored
whole, in one pass; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.llm.blocks import to_arrow_schema
from memengine.llm.common import held, only, sampled, table
from memengine.llm.textops import LOWER, pieces, utf8

#: The most texts that the model is fitted on, and the most bytes of them all.
MAX_ROWS, MAX_BYTES = 3000, 24 << 20
LOG2_BUCKETS = 15
DIMENSIONS = 16
EPOCHS, BATCH, RATE = 4, 32, 2.0
TARGET = 0.995
SIZES = (2, 3, 4)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # not the digits and fractions beyond ASCII that count as word characters
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each subword size: (bucket at each position, first and last position of each text in turn)."""
    texts = np.arange(len(offsets) - 1)
    padded = np.full(len(data) + 2 * len(texts) + max(SIZES), 0x20, dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat(2 * texts + 1, np.diff(offsets))] = LOWER[data]
    begin, end = offsets[:-1] + 2 * texts, offsets[1:] + 2 * texts + 2
    key = padded[: len(padded) - 3].astype(np.uint32)
    for size in range(2, max(SIZES) + 1):
        key = (key << np.uint32(8)) | padded[size - 1 : len(padded) - 4 + size]
        hashed = (key * np.uint32(_MULTIPLIERS[size])) >> np.uint32(32 - LOG2_BUCKETS)
        yield hashed, np.stack([begin, np.maximum(begin + 1, end - size + 1)], axis=1).ravel()


def _sum(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, spans)[::2]


class Model:
    """Scores of each language for each bucket, the temperature and the rejection bound."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights.astype(np.float32), bias
        self.temperature, self.least = 1.0, 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        count = np.zeros(len(offsets) - 1)
        for hashed, spans in buckets(data, offsets):
            count += spans[1::2] - spans[::2]
            for i in range(len(self.languages)):
                out[:, i] += _sum(self.weights[i][hashed].astype(np.float64), spans)
        return out / count[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(data, offsets) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def fit(texts: list[bytes], languages: list[str], seed: int = 1) -> Model:
    """Fit on labelled texts by stochastic gradient descent."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(set(languages))
    examples: list[tuple[bytes, int]] = []
    for text, language in zip(texts, languages, strict=True):
        y = names.index(language)
        examples.append((text, y))
        for size in (12, 30, 80, 200):
            a = int(rng.integers(0, max(1, len(text) - size)))
            examples.append((text[a : a + size], y))
    order = rng.permutation(len(examples))
    examples = [examples[i] for i in order]
    part = len(examples) // 5
    checks, examples = examples[:part], examples[part:]
    bags = []  # each text's buckets, the share of its subwords in each, and its language
    for text, y in examples:
        data = np.frombuffer(text, dtype=np.uint8)
        found, times = np.unique(np.concatenate([h[s[0] : s[1]] for h, s in buckets(data, np.array([0, len(data)]))]), return_counts=True)
        bags.append((found.astype(np.uint32), (times / times.sum()).astype(np.float32), y))
    embed = rng.normal(0, 0.1, (1 << LOG2_BUCKETS, DIMENSIONS))
    out, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    steps, done = EPOCHS * (len(bags) // BATCH + 1), 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(bags))
        for a in range(0, len(bags), BATCH):
            rows = [bags[i] for i in shuffled[a : a + BATCH]]
            rate = RATE * (1 - done / steps)
            done += 1
            sizes = np.array([len(x) for x, _, _ in rows])
            flat, part_of = np.concatenate([x for x, _, _ in rows]), np.concatenate([x for _, x, _ in rows])[:, None]
            hidden = np.add.reduceat(embed[flat] * part_of, np.append(0, np.cumsum(sizes)[:-1]))
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), [y for _, _, y in rows]] -= 1
            back = np.repeat(p @ out.T, sizes, axis=0) * part_of * (-rate * 8 / len(rows))
            out -= rate * hidden.T @ p / len(rows)
            bias -= rate * p.mean(axis=0)
            by = np.argsort(flat, kind="stable")  # several texts may share a bucket
            first = np.flatnonzero(np.append(True, flat[by][1:] != flat[by][:-1]))
            embed[flat[by][first]] += np.add.reduceat(back[by], first)
    model = Model(names, (embed @ out).T, bias)
    if checks:
        raw = b"".join(t for t, _ in checks)
        offsets = np.append(0, np.cumsum([len(t) for t, _ in checks]))
        z, y = model.logits(np.frombuffer(raw, dtype=np.uint8), offsets), np.array([y for _, y in checks])

        def loss(temperature: float) -> float:
            s = z / temperature
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.1, 10, 41), key=loss)
        which, score = model.predict(np.frombuffer(raw, dtype=np.uint8), offsets)
        by = np.argsort(-score, kind="stable")
        right = np.cumsum(which[by] == y[by]) / np.arange(1, len(by) + 1)
        good = np.flatnonzero(right >= TARGET)
        model.least = float(score[by][good[-1]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], list[str]]:
    """At most about max_rows texts of the rows of docs (id, text, lang), as many of each language, by the hash of the id."""
    sizes = {x["lang"]: x["n"] for x in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()}
    if not sizes:
        return [], []
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, max_rows / len(sizes) / n)])
    place = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) / float(1 << 30)
    rows = sampled(docs.where(place < share[F.col("lang")]).select("id", F.col("text").cast("binary").alias("text"), "lang"), 8, 2 * max_rows, max_bytes)
    return [bytes(x["text"]) for x in rows], [x["lang"] for x in rows]


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model from (id, text, lang) rows with a language and a text, None without any."""
    texts, languages = sample(docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0"), max_rows, max_bytes)
    return fit(texts, languages) if texts else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and confident."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, at any input size
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("confident", T.BooleanType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in dict(added)] + [T.StructField(n, t) for n, t in added])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            names = batch.schema.names
            data, offsets = utf8(batch.column(names.index(text_col)))
            for a, b in pieces(offsets):
                part = data[offsets[a] : offsets[b]]
                spans = offsets[a : b + 1] - offsets[a]
                raw = part.tobytes()
                lettered = np.array([_LETTER.search(raw[x:y].decode("utf-8", "replace")) is not None for x, y in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True)], dtype=bool)
                if own is None:
                    which, score, lettered = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a, dtype=bool)
                    languages = [UNKNOWN]
                else:
                    which, score = own.predict(part, spans)
                    languages = own.languages
                found = [languages[w] if ok else UNKNOWN for w, ok in zip(which.tolist(), lettered.tolist(), strict=True)]
                score = np.where(lettered, score, 0.0)
                columns = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(names)}
                columns |= {"lang_pred": pa.array(found, pa.string()), "score": pa.array(score), "confident": pa.array(lettered & (score >= (own.least if own else 1.0)))}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in kind], schema=kind)

    return docs.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), id="doc_id", text="text", lang="lang").withColumn("held_out", held("id", 4, 2))
    model = train(docs.where("NOT held_out").select("id", "text", "lang"))
    return identify(docs.select("id", "text", "held_out"), model).select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "confident")
