"""Operators with one right answer, against their plain forms on the small table."""

from __future__ import annotations

import base64
import hashlib
import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memengine.llm import bpe, decontamination, jaccard_join, ppm, quality, substring_dedup, textops, warc, winnowing
from memengine.llm.common import held
from tests.llm import brute
from tests.llm.conftest import prose as brute_prose


def by_row(found):
    return sorted(found, key=repr)


def test_jaccard_join(docs, rows, empty):
    want = brute.classes(rows)
    got = [tuple(r) for r in jaccard_join.similarity_classes(docs).collect()]
    assert by_row(got) == by_row([(i, len(brute.shingles(t)), want.get(i)) for i, t in rows])
    assert jaccard_join.similarity_classes(empty).collect() == []


def test_jaccard_join_at_its_bound(spark):
    """Unions and intersections right at 0.8 and one shingle below, between families too."""
    word = [f"w{i}" for i in range(300)]
    texts = [" ".join(word[a:b]) for a, b in ((0, 94), (10, 104), (11, 105), (21, 115), (0, 84), (0, 54), (0, 44), (200, 210), (200, 209), (201, 211))]
    texts += [" ".join(w for w in word if w != f"w{i}") for i in range(40, 70, 3)]
    table = list(enumerate(texts, 1))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_classes(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == brute.classes(table)


def random_families(seed: int):
    """Families around random texts, with chains from near to far: many pairs lie right at the bounds."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for c in range(6):
        base = [f"c{c}w{i}" for i in range(120)] + [f"s{i}" for i in range(40)]
        for _ in range(12):
            own = list(base)
            for i in rng.choice(len(own), int(rng.integers(0, 5)), replace=False).tolist():
                own[i] = f"x{rng.integers(0, 3)}"
            for i in range(int(rng.integers(0, 3))):
                own = own[: len(own) - int(rng.integers(0, 12))] if i else own[int(rng.integers(0, 9)) :]
            out.append(" ".join(own))
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("seed", "radius", "block"), [(1, 5, 64), (2, 5, 4), (3, 12, 4), (4, 0, 2)])
def test_jaccard_join_derives_answers(spark, monkeypatch, seed, radius, block):
    """Sets that leave the search to others, lists by blocks, and families that search again lose no link."""
    monkeypatch.setattr(jaccard_join, "RADIUS", radius)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_TASK", 3)
    table = random_families(seed)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_classes(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == brute.classes(table)


def test_substring_dedup(docs, rows, empty):
    got = substring_dedup.dedup_substrings(docs).collect()
    want = brute.deduplicated(rows)
    assert by_row([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_words"]) for r in got]) == by_row([(i, n, n - len(kept), " ".join(kept)) for i, n, kept in want])
    texts = {(i, t if len(kept) == n else " ".join(kept)) for (i, n, kept), (_, t) in zip(want, rows, strict=True)}
    assert {(r["doc_id"], r["text"]) for r in got} == texts
    assert {r["block"] for r in got} == {0} and {r["body"] for r in got} == {"b"}  # the caller's own columns
    assert substring_dedup.dedup_substrings(empty).collect() == []


def test_substring_dedup_of_many_blocks(spark, monkeypatch):
    """Passages in nearly every block take the salted way, others the plain one; both are right."""
    monkeypatch.setattr(substring_dedup, "OFTEN", 6)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    shared = [brute_prose(i, 20) for i in range(3)]
    table = [(i, f"{brute_prose(100 + i, 15)} {shared[0]} {shared[1] if i % 7 == 0 else ''} {shared[2] if i in (5, 50) else ''}") for i in range(60)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    assert by_row([(r["doc_id"], r["n_words"], r["kept_words"].split()) for r in got]) == by_row(brute.deduplicated(table))


def test_window_hashes_that_agree_in_one_half():
    known = tuple(np.array(x, dtype=np.uint64) for x in ([3, 5, 5, 5, 9], [1, 2, 4, 6, 1]))
    hit, spot = substring_dedup._located(known, np.array([5, 5, 5, 3, 10], dtype=np.uint64), np.array([6, 2, 3, 1, 1], dtype=np.uint64))
    assert hit.tolist() == [True, True, False, True, False] and spot[hit].tolist() == [3, 1, 0]


def test_ids_are_whole_numbers(spark):
    named = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError, match="doc_id"):
        substring_dedup.dedup_substrings(named)


def test_decontamination(spark, docs, rows, empty):
    base, other = dict(r for r in rows if r[0] is not None)[7], dict(r for r in rows if r[0] is not None)[11]
    items = [(1, " ".join(base.split()[10:30])), (2, "TWO-words!"), (3, None), (4, "..."), (5, other.replace(" ", " , ")), (None, "stone stone"), (1, "never there"), (10, " ".join(base.split()[12:26]))]
    table = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id long")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.contamination(docs, table).collect()]
    assert by_row(got) == by_row(brute.contaminated(rows, items))
    shuffled = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.contamination(docs, table, broadcast_bytes=0).collect()]
    assert by_row(shuffled) == by_row(got)
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in decontamination.contamination(docs, table.limit(0)).collect())
    assert decontamination.contamination(empty, table).collect() == []


def test_bpe_is_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode(docs).collect()]
    assert by_row(got) == by_row(want)
    assert bpe.encode(empty).collect() == []


@pytest.mark.parametrize("text", ["aaaaaaaaaaa", "  two  spaces ", "\n\n x\t\ty", "it's I'll 12 345", "\x1c \x1d", "é̂ combining", "<|endoftext|><|endoftext|>", "naïve 東京 　wide", " ", "a" * 3001, "don't  \r\n  stop"])
def test_bpe_of_odd_texts(text):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.read(bpe.default_path()))
    (ids,) = own.encode([text])
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_ppm(docs, rows, empty):
    order = 3
    some = docs.where("doc_id IS NULL OR doc_id NOT IN (13, 23)").withColumn("held_out", held("doc_id", 7, 2))
    mine = [(i, t) for i, t in rows if i not in (13, 23)]
    out = {i: i is not None and brute.crc(i) % 7 == 2 for i, _ in mine}
    train = [t for i, t in mine if not out[i]]
    counts = brute.levels(train, order)
    known = brute.Counter(w for t in train for w in brute.words(brute.lower(t or "")))
    known["\n"] = len(train)  # the end
    total, kinds = sum(known.values()), len(known)
    want = []
    for i, t in mine:
        own = [*brute.words(brute.lower(t or "")), "\n"]
        base = sum(math.log10((known[w] + 1) / (total + kinds + 1)) for w in own)
        want.append((i, out[i], len(own), sum(known[w] > 0 for w in own), total, round(base, 6), round(brute.ppm_score(t, counts, order), 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ppm.score(some, order=order).collect()]
    assert [x[:5] for x in by_row(got)] == [x[:5] for x in by_row(want)]
    for a, b in zip(by_row(got), by_row(want), strict=True):
        assert a[5:] == pytest.approx(b[5:], abs=1e-4)
    assert ppm.score(empty.withColumn("held_out", F.lit(True))).collect() == []


def test_ppm_of_many_blocks(spark, docs, monkeypatch):
    """Blocks, and the way that common words take, change nothing."""
    some = docs.where("doc_id NOT IN (13, 23)").withColumn("held_out", held("doc_id", 7, 2))
    want = by_row([tuple(r) for r in ppm.score(some, order=2).collect()])
    monkeypatch.setattr(ppm, "BLOCK", 300)
    monkeypatch.setattr(ppm, "MANY_BLOCKS", 4)
    got = by_row([tuple(r) for r in ppm.score(some, order=2).collect()])
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


@pytest.mark.parametrize("values", [np.float32, np.int64])
def test_ppm_answers(values):
    """Every key is found, also one whose slot another has; others get what was asked for."""
    rng = np.random.Generator(np.random.PCG64(3))
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    rng.shuffle(keys)
    keys[:2] = 0, (1 << 64) - 1
    found = ppm.Answers(keys[:4000], np.arange(4000).astype(values))
    assert len(found.lost) and len(found.slots) < 1 << 14
    got = found.find(np.concatenate([keys, keys[:9]]), np.append(np.full(len(keys), -1.0), np.full(9, -2.0)))
    assert got[:4000].tolist() == list(range(4000)) and set(got[4000 : len(keys)]) == {-1.0} and got[len(keys) :].tolist() == list(range(9))
    assert ppm.Answers(keys[:0], np.zeros(0)).find(keys[:3], 5.0).tolist() == [5.0] * 3
    assert np.isnan(ppm.Answers(keys[:1], np.ones(1)).find(keys[:2], np.nan)[1])


def test_worker_keeps_no_tables_of_powers():
    """A worker that lives on between tasks holds nothing of them; a text handled after that has the same hashes."""
    data = np.frombuffer(b"one two three", dtype=np.uint8)
    hashes = lambda: textops.Words(data, np.array([0, len(data)])).hashes().tolist()
    before = hashes()
    assert textops._POWERS
    textops.give_back()
    assert not textops._POWERS and hashes() == before


def test_jaccard_counters(spark):
    """The counters of frequent shingles, where two shingles share one and where none is frequent."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f g"] * 3 + ["h i j k l"] * 2 + ["m n o p q", None])], "id long, text string").coalesce(1)
    want = np.zeros(1 << jaccard_join.LOG2_COUNTERS, dtype=np.int32)
    for text, n in (("a b c d e f g", 3), ("h i j k l", 2)):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        np.add.at(want, (next(jaccard_join.shingle_sets(raw, np.array([0, len(raw)]))) & np.uint64(len(want) - 1)).astype(np.int64), n)
    assert (jaccard_join._estimate(docs, 5) == want).all()
    assert not jaccard_join._estimate(docs.where("id >= 5"), 5).any()


def test_bpe_forgets_pieces(monkeypatch):
    """What a worker keeps is bounded, also by bytes; ids stay right."""
    own = bpe.encoder(bpe.read(bpe.default_path()))
    want = own.encode(["alpha beta", "x" * 400])
    monkeypatch.setattr(bpe, "KEPT_BYTES", 100)
    assert own.encode(["alpha beta", "y" * 300]) [0] == want[0] and own.encode(["alpha beta", "x" * 400]) == want
    assert own.kept < 5000


def test_bpe_keeps_pre_tokens_alone():
    """Words with signs behind them share their word's ids; what is kept grows with pre-tokens, not with their combinations."""
    from tokenizers import Tokenizer

    own = bpe.Encoder(bpe.read(bpe.default_path()))
    text = " ".join(["alpha", "é", *(f"{w}{s}{e}" for w in ("alpha", "beta", "naïve") for s in (",", ".", "%%", ".\n") for e in ("", "Beta", "12", "'s"))])
    (ids,) = own.encode([text])
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == Tokenizer.from_file(bpe.default_path()).encode(text, add_special_tokens=False).ids
    assert own.kept < 300


@pytest.mark.parametrize("ids", [1 << 16, 3])
def test_bpe_decodes_a_batch_at_once(monkeypatch, ids):
    """Broken characters are replaced within their own text."""
    monkeypatch.setattr(bpe, "DECODED_IDS", ids)
    own = bpe.encoder(bpe.read(bpe.default_path()))
    whole, cut = own.encode(["naïve 東京", "東"])
    assert own.decode_all([whole, b"", cut[:4], whole]).to_pylist() == ["naïve 東京", "", own.decode(cut[:4]), "naïve 東京"]
    assert "\ufffd" in own.decode(cut[:4]) and own.decode_all([b"", b""]).to_pylist() == ["", ""] and own.decode_all([]).to_pylist() == []


def test_kneser_ney(spark, docs, rows, empty):
    order = 2
    some = docs.where("doc_id IS NULL OR doc_id NOT IN (13, 23)")
    labels = spark.createDataFrame([(i, 0 if i in (5, 22) else 1, 9) for i in range(1, 23)] + [(4, 0, 9), (7, 1, 9), (None, 1, 9), (99, None, 9)], "doc_id long, quality int, id long")
    mine = [(i, t) for i, t in rows if i not in (13, 23)]
    train = [t for i, t in mine if i is not None and 1 <= i <= 22 and i not in (4, 5, 22) and brute.crc(i) % 5 != 4]
    counts = brute.levels(train, order)
    got = by_row([(r["id"], r["n_symbols"], round(r["log10_p"], 3)) for r in quality.perplexities(some, labels, order).collect()])
    want = by_row([(i, len(brute.symbols(t)), round(brute.kneser_ney(t, counts, order), 3)) for i, t in mine])
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[2] == pytest.approx(b[2], abs=0.02, rel=1e-4)
    assert all(r["keep"] for r in quality.classify(some.limit(3), labels.limit(0)).collect())
    assert quality.classify(empty, labels).collect() == []


def plain_tokens(text):
    return [w[i : i + 8] for w in brute.words((text or "").lower()) for i in range(max(1, len(w) - 7))]


def plain_marks(text, k=winnowing.K, w=winnowing.W):
    """(hash, position) by a rolling update, one place after the other, and the rightmost least of each window."""
    codes = [(x - (x >> 63 << 64)) % winnowing.PRIME for t in plain_tokens(text) for x in [xxhash.xxh64(t.encode(), seed=42).intdigest()]]
    hashes, h = [], 0
    for i, c in enumerate(codes):
        h = (h * winnowing.BASE + c) % winnowing.PRIME
        if i >= k:
            h = (h - codes[i - k] * pow(winnowing.BASE, k, winnowing.PRIME)) % winnowing.PRIME
        if i >= k - 1 or i == len(codes) - 1:
            hashes.append(h)
    out = []
    for a in range(max(1, len(hashes) - w + 1)) if hashes else ():
        place = min(range(a, min(a + w, len(hashes))), key=lambda i: (hashes[i], -i))
        if (hashes[place], place) not in out[-1:]:
            out.append((hashes[place], place))
    return out


@pytest.mark.parametrize(("k", "w"), [(winnowing.K, winnowing.W), (6, 2), (3, 8), (1, 4)])
def test_winnowing_of_hashes(docs, rows, empty, k, w):
    found = winnowing.fingerprints(docs, k=k, w=w).select("doc_id", "text", "marks", "fingerprint").collect()
    assert len(found) == len(rows)
    prints: dict = {}
    for r in found:
        assert [tuple(m) for m in r["marks"]] == plain_marks(r["text"], k, w)
        assert prints.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    assert winnowing.fingerprints(empty).collect() == []


def test_winnowing_ties_go_right(spark):
    """Equal tokens give equal hashes: each window's mark is its last place."""
    (r,) = winnowing.fingerprints(spark.createDataFrame([("same " * 12,)], "text string")).collect()
    assert [m["position"] for m in r["marks"]] == [3, 4, 5, 6, 7]


@pytest.mark.parametrize("ids", [[5], [3, 9, -4, 10**15, 10**15 + 1, 10**15 + 2], list(range(50))])
def test_successors(spark, monkeypatch, ids):
    monkeypatch.setattr(winnowing, "RANGE_IDS", 4)
    got = {r["id"]: r["next"] for r in winnowing.successors(spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "id long")).collect()}
    order = sorted(ids, reverse=True)
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_winnowing_guarantee(spark):
    """Texts that share k + w - 1 tokens share a mark."""
    passage = " ".join(f"tok{i}" for i in range(winnowing.K + winnowing.W - 1))
    df = spark.createDataFrame([(f"left only {passage} tail one", f"another start of it {passage}")], "a string, b string")
    r = winnowing.with_marks(df, {"x": "a", "y": "b"}).first()
    assert {m["hash"] for m in r["x"]} & {m["hash"] for m in r["y"]}


def test_winnowing_unspaced(spark):
    """A passage within unspaced runs is found at any offset; tokens are those of a plain cut."""
    passage = "".join(chr(0x4E00 + i * 37 % 2000) for i in range(40))
    texts = [f"{'x' * i}{passage}" for i in range(9)]
    found = winnowing.fingerprints(spark.createDataFrame(enumerate(texts), "id long, text string")).collect()
    prints = [{m["hash"] for m in r["marks"]} for r in found]
    assert all(prints[0] & other for other in prints)
    text = "abc exactly8 ninechars \U0001F600abcdefgh i"
    (r,) = winnowing.fingerprints(spark.createDataFrame([(text,)], "text string")).collect()
    assert [tuple(m) for m in r["marks"]] == plain_marks(text)


def test_winnowing_query(docs, rows, empty):
    got = winnowing.compared(docs).collect()
    texts: dict = {}
    for i, t in rows:
        if i is not None:
            texts[i] = min(texts.get(i, t or ""), t or "")
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    want = []
    for i, t in rows:
        t, other = t or "", texts[after[i]] if i is not None else ""
        half = len(t) // 2
        want.append((i, len(t), brute.sha(t[: len(t) - half] + other[:half])))
    assert by_row([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got]) == by_row(want)
    for r in got:
        a, b = set(r["fingerprint"].split()), set(r["edited_fingerprint"].split())
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        if r["doc_id"] not in (None, 16):  # two rows
            own, far = ({h for h, _ in plain_marks(t)} for t in (texts[r["doc_id"]], texts[after[r["doc_id"]]]))
            assert r["near_next"] == pytest.approx(len(own & far) / len(own | far) if own | far else 1.0)
            assert r["positions"] == [i for _, i in plain_marks(texts[r["doc_id"]])]
    assert winnowing.compared(empty).collect() == []


def digest(h: str) -> str:
    return base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_warc(spark, tmp_path, split):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Type: application/http\r\nContent-Length: 26\r\n\r\nHTTP/1.1 200 OK\r\n\r\nforged!\r\n\r\n"
    pages = [(1, "http://a/1", "same é"), (2, "http://a/2\nx", "same é"), (3, None, None), (4, "u", ""), (5, "u", f"<p>{fake}{fake}</p>"), (6, "u", fake), (7, "u", "WARC/1.1\r\n"), (8, "u", "x" * 4000 + fake), (9, "u", f"<p>{fake}{fake}</p>"), (None, "u", "nameless"), (10, "u", "\r\n\r\n\r\n\r\n"), (10, "u", "\r\n\r\n\r\n\r\n")]
    table = spark.createDataFrame([(*p, "k", 5) for p in pages], "page_id long, url string, html string, file string, digest long").repartition(2)
    folder = str(tmp_path / "w")
    warc.write_warc(table, folder, broadcast_bytes=0 if split == "700b" else warc.BROADCAST_BYTES)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [tuple(r)[:5] for r in warc.read_warc(spark, folder).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    top: dict = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        own = i is None or top[h or ""] == i
        want.append((i, len((h or "").encode()), digest(h or ""), "response" if own else "revisit", None if own else top[h or ""]))
    assert by_row(got) == by_row(want)


def damaged(spark, tmp_path, change):
    """(page ids read, faults) of an archive of five records of which the bytes are changed."""
    folder = tmp_path / "w"
    warc.write_warc(spark.createDataFrame([(i, "u", f"page {i} " + "y" * 400) for i in range(1, 6)], "page_id long, url string, html string").coalesce(1), str(folder))
    (file,) = folder.glob("part-*.txt")
    whole = file.read_bytes()
    starts = [i for i in range(len(whole)) if whole.startswith(warc.VERSION.encode(), i)]
    for x in folder.iterdir():
        x.unlink()
    (folder / "a.warc").write_bytes(change(whole, starts))
    return {r["page_id"] for r in warc.read_warc(spark, str(folder)).collect()}, [(r["offset"], r["fault"]) for r in warc.faults(spark, str(folder)).collect()], starts


def test_warc_cut_off_at_its_end(spark, tmp_path):
    ids, found, starts = damaged(spark, tmp_path, lambda whole, starts: whole[:-300])
    assert len(ids) == 4 and found == [(starts[4], "does not end where it says")]


def test_warc_with_bytes_missing_in_the_middle(spark, tmp_path):
    ids, found, starts = damaged(spark, tmp_path, lambda whole, starts: whole[: starts[2] - 50] + whole[starts[2] - 45 :])
    assert len(ids) == 1 and found == [(starts[1], "does not end where it says")]


def test_warc_with_an_absurd_length(spark, tmp_path):
    ids, found, starts = damaged(spark, tmp_path, lambda whole, starts: whole[: starts[4]] + whole[starts[4] :].replace(b"response\r\nContent-Length: ", b"response\r\nContent-Length: 99999999999"))
    assert len(ids) == 4 and found == [(starts[4], "does not end where it says")]


def test_warc_without_a_length(spark, tmp_path):
    ids, found, starts = damaged(spark, tmp_path, lambda whole, starts: whole[: starts[4]] + whole[starts[4] :].replace(b"Content-Length", b"Content-Weight"))
    assert len(ids) == 4 and found == [(starts[4], "no length")]


def test_warc_that_begins_with_something_else(spark, tmp_path):
    ids, found, _ = damaged(spark, tmp_path, lambda whole, starts: b"junk" + whole)
    assert ids == set() and found == [(0, "does not begin with a record")]


def test_warc_with_a_changed_payload(spark, tmp_path):
    ids, found, starts = damaged(spark, tmp_path, lambda whole, starts: whole[: starts[3] - 20] + b"z" + whole[starts[3] - 19 :])
    assert len(ids) == 4 and found == [(starts[2], "another digest")]


def test_warc_of_empty_files(spark, tmp_path):
    ids, found, _ = damaged(spark, tmp_path, lambda whole, starts: b"")
    assert ids == set() and found == []


def test_warc_of_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).collect() == []


def test_warc_smaller_payloads_stay(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_warc(table, str(tmp_path / "w"), least_bytes=3)
    assert {(r["page_id"], r["record_type"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}
