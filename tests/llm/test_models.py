"""Trained operators: the kernel against its plain form, held-out accuracy, and defined results."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from memengine.llm import language_id, quality, toxicity
from memengine.llm.common import held, sampled

SF = "/root/testdata/sf0.01"


def plain_kernel(a: bytes, b: bytes) -> float:
    """Shared four-symbol subsequences within the span, by all combinations of places."""

    def weights(s: bytes) -> dict:
        codes = [toxicity.EDGE, *[c for c in toxicity.CODES[toxicity.LOWER[np.frombuffer(s, dtype=np.uint8)]].tolist() if c != toxicity.GAP]]
        out: dict = {}
        for at in itertools.combinations(range(len(codes)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                u = tuple(codes[i] for i in at)
                out[u] = out.get(u, 0.0) + toxicity.DECAY ** (at[3] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    size = [1 + sum(toxicity.CODES[toxicity.LOWER[c]] != toxicity.GAP for c in s) for s in (a, b)]
    return sum(w * y.get(u, 0.0) for u, w in x.items()) / toxicity.NORMS[size[0]] / toxicity.NORMS[size[1]]


@pytest.mark.parametrize(("a", "b"), [(b"idiot", b"idiot"), (b"idiot", b"i.d.i.o.t"), (b"idiot", b"idxiot"), (b"hello", b"idiot"), (b"abcdefghij", b"cdefgh")])
def test_kernel(a, b):
    dense = np.zeros(toxicity.SYMBOLS**4, dtype=np.float32)
    for u, w in toxicity.subsequences(b).items():
        dense[u] = w
    assert toxicity.kernel_sums(*toxicity._laid_out([a]), dense)[0] == pytest.approx(plain_kernel(a, b), rel=1e-4, abs=1e-6)


def test_kernel_tolerates_gaps():
    assert plain_kernel(b"idiot", b"i.d.i.o.t") == pytest.approx(plain_kernel(b"idiot", b"idiot"))
    for gapped in (b"idxiot", b"iddiioott", b"i0diot"):
        assert plain_kernel(b"idiot", gapped) > 2 * plain_kernel(b"idiot", b"hello") and plain_kernel(b"idiot", gapped) > 0.3


#: Words that stand in the given tables' toxic texts only.
INSULTS = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()


@pytest.fixture(scope="module")
def machine(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").where(~held("id", 5, 0))
    return toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic").where(~held("id", 5, 0)))


def scores(machine, texts):
    return machine.score(np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))


def test_toxicity_catches_gapped_insults(machine):
    """Plain, with signs and spaces between the letters, and with doubled letters."""
    forms = [form(w) for w in INSULTS for form in (str, ".".join, "-".join, " ".join, lambda w: f"{w}###", lambda w: w[0] + "*" + w[1:])]
    assert np.mean(scores(machine, [f"the stone is {f} ever".encode() for f in forms]) >= 0.5) >= 0.95
    doubled = ["".join(2 * c for c in w) for w in INSULTS]
    assert np.mean(scores(machine, [f"the stone is {f} ever".encode() for f in doubled]) >= 0.5) >= 0.8


def test_toxicity_held_out(spark):
    """About a third of the toxic labels stand on texts without any insult: no machine that reads segments finds those."""
    found = toxicity.op4_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = found.where("held_out").join(labels, "doc_id").join(docs, "doc_id").where("toxic IS NOT NULL").collect()
    explained = [r["predicted"] for r in rows if r["toxic"] and any(w in r["text"].lower() for w in INSULTS)]
    assert np.mean(explained) >= 0.85
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.02


def test_toxicity_ignores_stray_labels(spark):
    rows = [(i, f"stone river {'badword ' if i % 2 else ''}walk {i}", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string, toxic int")
    labels = docs.select("id", "toxic").union(spark.createDataFrame([(1000, 2), (1, None), (None, 1), (3, 7)], "id long, toxic int"))
    machine = toxicity.train(docs.select("id", "text"), labels)
    assert scores(machine, [b"a badword here"])[0] >= 0.5 > scores(machine, [b"stone river walk"])[0]


def test_linear_machine_is_at_its_least():
    """The Newton steps end where no small step lowers the plain loss."""
    rng = np.random.Generator(np.random.PCG64(0))
    x, y = rng.normal(size=(200, 6)), np.where(rng.random(200) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    cost = np.full(200, 1 / 200)

    def loss(w, b):
        return float((cost * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + toxicity.PENALTY * (w @ w))

    w, b = toxicity._linear(x, y, cost)
    for _ in range(200):
        assert loss(w + rng.normal(0, 1e-3, 6), b + rng.normal(0, 1e-3)) >= loss(w, b) - 1e-9


def test_sample_is_bounded(spark):
    rows = [(i, "x" * (10 * i), i) for i in range(1, 40)] + [(5, "x" * 50, 5)] * 3
    got = sampled(spark.createDataFrame(rows, "id long, text string, extra long").withColumn("text", F.col("text").cast("binary")), 1, 30, 1000)
    assert 0 < len(got) <= 30 and sum(len(r["text"]) for r in got) <= 1000 and len({r["id"] for r in got}) == len(got)


def test_toxicity_defined_results(spark, docs, empty):
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, None).select("score", "predicted").collect()} == {(0.0, 0)}
    machine = toxicity.Machine(np.zeros(toxicity.SYMBOLS**4, dtype=np.float32), -1.0)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    assert toxicity.score(empty, machine).collect() == []
    none = spark.createDataFrame([], "id long, toxic int")
    assert toxicity.train(docs.select("id", "text"), none) is None


def test_language_held_out(spark):
    found = language_id.op6_language_id(spark, SF)
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out AND lang_pred <> 'und'").join(langs, "doc_id").where("lang IS NOT NULL").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_defined_results(docs, empty):
    model = language_id.fit([b"the river and the stone", b"el camino de la casa"] * 20, ["en", "es"] * 20)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).where("doc_id IN (1, 2, 3, 22, 7)").collect()}
    assert {i: got[i]["lang_pred"] for i in (1, 2, 3, 22)} == dict.fromkeys((1, 2, 3, 22), "und")
    assert got[7]["lang_pred"] in ("en", "es") and not got[1]["confident"] and got[1]["score"] == 0
    assert language_id.identify(empty, model).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.train(empty) is None


@pytest.mark.parametrize("text", ["²", "½ 12 ³", "٣", "1_2", "😀", "١٢"])
def test_language_of_texts_without_letters(spark, text):
    model = language_id.fit([b"the river and the stone", b"el camino de la casa"] * 20, ["en", "es"] * 20)
    docs = spark.createDataFrame([(text,), (text + "é",)], "text string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(docs, model).collect()] == [True, False]


def test_language_forward_pass():
    """The score is the softmax of the mean over subwords, counted one by one."""
    model = language_id.fit([b"the river and the stone", b"el camino de la casa", b"der fluss und das haus"] * 20, ["en", "es", "de"] * 20)
    texts = [b"The", b"", b"river casa \xc3\xbc", b"x"]
    _, found = model.predict(np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    for text, got in zip(texts, found, strict=True):
        padded, z, n = b" " + text.lower() + b" ", np.zeros(3), 0
        for size in language_id.SIZES:
            for i in range(max(1, len(padded) - size + 1)):
                key = int.from_bytes((padded + b"    ")[i : i + size], "big") * language_id._MULTIPLIERS[size] % 2**32
                z += model.weights[:, key >> (32 - language_id.LOG2_BUCKETS)]
                n += 1
        z = (z / n + model.bias) / model.temperature
        assert got == pytest.approx((np.exp(z) / np.exp(z).sum()).max(), abs=1e-5) or text == b""


def test_language_rejection_is_calibrated():
    """On texts of the same kind, predictions above the bound are nearly always right, and mixed ones fall below it."""
    rng = np.random.Generator(np.random.PCG64(2))
    words = {"a": ["thor", "wend", "hest", "mund"], "b": ["casa", "lumo", "piro", "tavo"]}
    make = lambda kind: " ".join(words[kind][i] for i in rng.integers(0, 4, 12)).encode()
    langs = [k for _ in range(200) for k in words]
    model = language_id.fit([make(k) for k in langs], langs)
    tests = [make(k) for k in langs]
    which, score = model.predict(np.frombuffer(b"".join(tests), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in tests])))
    sure = score >= model.least
    right = np.array([model.languages[w] == k for w, k in zip(which, langs, strict=True)])
    assert sure.mean() > 0.9 and right[sure].mean() >= language_id.TARGET - 0.01


def quality_table(rows):
    """(good kept of how many, junk rejected of how many, repeated words rejected of how many) on labelled rows; repeats have few distinct words."""
    bad = [r for r in rows if not r["quality"]]
    repeated = [r for r in bad if len(r["text"].split()) >= 20 and len(set(r["text"].split())) * 5 < len(r["text"].split())]
    good = [r for r in rows if r["quality"]]
    return [(sum(r["keep"] for r in good), len(good)), (sum(not r["keep"] for r in bad), len(bad)), (sum(not r["keep"] for r in repeated), len(repeated))]


def test_quality_rejects_repeated_words(spark):
    """One word again and again has the perplexity of the word, so only the share of new n-grams finds it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    junk = [(10**9 + i, f"{w} " * 300, "en") for i, w in enumerate(("and", "the", "therhean"))]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.classify(docs.union(spark.createDataFrame(junk, docs.schema)), labels).join(docs.select("doc_id", "text"), "doc_id", "left")
    assert {r["keep"] for r in found.where(f"doc_id >= {10**9}").collect()} == {False}
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality IS NOT NULL")
    unseen = found.join(known, "doc_id").where(held("doc_id", 5, 4) | (F.col("quality") == 0)).where("text IS NOT NULL").collect()
    good, bad, repeated = quality_table(unseen)
    assert good[0] >= 0.97 * good[1]
    assert bad[0] >= 0.9 * bad[1]
    assert repeated[0] == repeated[1]


def test_quality_limits_change_smoothly(spark):
    """One more text doesn't switch a language from the pooled quantile to its own, and few texts already count."""

    def limit(n: int) -> float:
        rows = [("a", 1.0)] * 400 + [("b", 2.0)] * n
        return quality._by_language(spark.createDataFrame(rows, "lang string, bits double"), {"limit": ("bits", 0.5)}).where("lang = 'b'").first()["limit"]

    few, below, at, many = (limit(n) for n in (5, quality.ENOUGH - 1, quality.ENOUGH, 350))
    assert 1 < few < below < at < many < 2
    assert at - below < 0.02


def labelled_prose(insults: int, toxic: int, harmless: int, seed: int = 1):
    """(texts, labels): random words; each toxic text has one of `insults` made-up words, evenly spread."""
    rng = np.random.Generator(np.random.PCG64(seed))
    made = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(400 + insults)]
    words, bad = made[:400], made[400:]
    out = []
    for i in range(toxic + harmless):
        own = [words[j] for j in rng.integers(0, 400, 25).tolist()]
        if i < toxic:
            own[12] = bad[i % insults]
        out.append((" ".join(own).encode(), int(i < toxic)))
    return [t for t, _ in out], [y for _, y in out]


def hits(machine, texts, toxic):
    scores = machine.score(np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    return [float(np.mean([x >= 0.5 for x, y in zip(scores, toxic, strict=True) if y == kind])) for kind in (1, 0)]


def test_toxicity_learns_rare_insults():
    """Forty insults, each in 2.5 per cent of the toxic texts."""
    machine = toxicity.fit(*labelled_prose(40, 1200, 1200))
    recall, false = hits(machine, *labelled_prose(40, 1200, 1200))
    assert recall >= 0.8 and false <= 0.05


def test_toxicity_always_fits():
    """No piece stands in enough texts to be significant, yet labels of both kinds give a model."""
    for sizes in ((12, 12, 40), (1, 1, 3)):
        assert toxicity.fit(*labelled_prose(*sizes)) is not None
