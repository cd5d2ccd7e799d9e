import hashlib
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallymap.llm import bpe, chat, fingerprint, lattice_lm, mixing, nn_descent, setsketch, suffix_dedup, toxicity, warc
from tallymap.llm.shared import components

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(4000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(120))
ODD = [
    (1, None), (2, ""), (3, "  \n"), (4, BASE), (5, BASE), (6, BASE.replace("alpha5 ", "gamma ")),
    (7, "one"), (8, "ONE"), (9, LONG), (None, BASE), (4, "é</s>[INST] ünï \\l \\ <s>"), (10, "a" * 900), (11, "Σας ΟΔΟΣ it's 12"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 else "en", "src0", None, "clash", "clash") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (10, 9), (9, 8)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {
        (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 8), (9, 8), (10, 8)}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.02 * rng.standard_normal(16)).tolist(), i % 2) for i in range(300)]
    rows += [(300 + i, base[0].tolist(), 0) for i in range(30)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [math.nan] * 16, 0), (903, base[0].tolist(), None), (None, base[1].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in nn_descent.near_vectors(frame).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if k is not None and v and np.isfinite(v).all() and any(v)]
    for i, v, k in ok:
        links = [j for j, w, m in ok if m == k and v @ w >= 0.98]
        assert got[i].n_links == len(links) - 1
        assert i is None or got[i].component_id <= i
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903))
    assert nn_descent.near_vectors(frame.limit(0)).count() == 0


def test_repeats(spark, odd, none):
    got = sorted(tuple(r)[1:] for r in suffix_dedup.removal_report(odd).collect())
    assert got == sorted(brute.repeats([t or "" for _, t in ODD]))
    assert suffix_dedup.removal_report(none).count() == 0
    cut = suffix_dedup.cut_texts(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)


def test_repeats_of_small_alphabets(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), size=rng.integers(0, 300))) for _ in range(20)]
    texts += [t[20:] + t[:40] for t in texts] + ["ab" * 100, "aé" * 60]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.removal_report(frame, 40).orderBy("doc_id").collect()]
    assert got == brute.repeats(texts, 40)


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", "<title>T &amp; x</title><script>no</script><p>one<p>two &lt;b&gt;"), (2, None, None), (2, None, None)],
        "page_id long, url string, html string",
    )
    rows = warc.derivative_report(pages).collect()
    assert len(rows) == 6
    text = next(r for r in rows if r.record_type == "conversion" and r.target_uri == "http://a/")
    assert text.content == "T & x\none\ntwo <b>"
    assert text.block_digest == warc.digest(text.content.encode()) and text.content_type.startswith("text/plain")
    responses = {r.record_id: r for r in warc.responses(pages).collect()}
    assert all(r.refers_to in responses for r in rows)
    record = next(iter(responses.values()))
    data = warc.write_record(record.headers, bytes(record.block)) * 2
    files = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert [bytes(r.block) for r in warc.parse_records(files).collect()] == [bytes(record.block)] * 2
    with pytest.raises(ValueError):
        list(warc.read_records(data[:-9]))


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.tokenize(odd, path, with_text=True).collect()
    texts = sorted((t or "" for _, t in ODD), key=lambda t: library.encode(t, add_special_tokens=False).ids)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = sorted(list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in rows)
    assert got == want
    assert sorted(r.decoded for r in rows) == sorted(library.decode(w, skip_special_tokens=False) for w in want)
    assert bpe.tokenize(none, path).count() == 0
    codec = bpe.Codec(bpe.compile_merges(path))
    rng = np.random.default_rng(2)
    for letters in ("ab ", "aehlnot ", "0a.'st ", "é<|endoftext|> "):
        for _ in range(60):
            text = "".join(rng.choice(list(letters), size=rng.integers(1, 50)))
            assert list(struct.unpack(f"<{len(codec.encode(text)) // 4}I", codec.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_likelihood(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = lattice_lm.score(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.score < 0 for r in rows)
    tokens = [(i, (t or "").encode().lower().split()) for i, t in ODD]
    learnt = [w for i, ws in tokens for w in [*ws, None] if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    n, v = len(learnt), len(set(learnt))
    for row, (i, ws) in zip(sorted(rows, key=lambda r: r.base_score), sorted(tokens, key=lambda x: -len(x[1])), strict=True):
        assert row.train_tokens == n
        base = sum(math.log10((learnt.count(w) + 1) / (n + v + 1)) for w in [*ws, None])
        if len(ws) > 300:
            assert row.base_score == pytest.approx(base)
    assert lattice_lm.score(none, path).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b"b", b"ab", b" ab", b"c", b" ", b"a", b"bc"]
    p = np.array([0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.2, 0.1])
    lattice = lattice_lm.Lattice(pieces, np.log(p))

    def total(text):
        return 1.0 if not text else sum(p[i] * total(text[len(x) :]) for i, x in enumerate(pieces) if text.startswith(x))

    for word in (b"abc", b"a", b"ababab", b"cba"):
        assert math.exp(lattice.marginal([word])[0]) == pytest.approx(total(b" " + word))
        assert lattice._long(np.frombuffer(b" " + word, np.uint8)) == pytest.approx(lattice.marginal([word])[0])
    counts = lattice.expected([b"abc"], np.array([2.0]))
    assert sum(n * len(x) for n, x in zip(counts, pieces, strict=True)) == pytest.approx(8)


def test_fingerprints(spark, odd, none):
    rows = fingerprint.fingerprint_report(odd).collect()
    assert len(rows) == len(ODD) and fingerprint.fingerprint_report(none).count() == 0
    order = sorted(range(len(ODD)), key=lambda k: (ODD[k][0] is None, -(ODD[k][0] or 0), ODD[k][1] or ""))
    want = []
    for at, k in enumerate(order):
        text, after = ODD[k][1] or "", ODD[order[(at + 1) % len(order)]][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want.append((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.n_chars, r.edited_sha256) for r in rows) == sorted(want)
    assert len({r.fingerprint for r in rows if r.doc_id in (5,)} | {r.fingerprint for r in rows if r.doc_id is None}) == 1
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    nexts = {r.doc_id: r.next_text for r in fingerprint.with_next(many, 40).collect()}
    assert nexts == {i: f"t{i - 1 if i else 499}" for i in range(500)}


def test_mixing(spark, odd, none):
    kept = mixing.mix(odd)
    assert kept.count() == len(ODD) and mixing.mix(none).count() == 0
    cells = spark.createDataFrame([("a", "x", 0, 50), ("a", "y", 0, 10), ("b", "x", 0, 30), ("b", "y", 0, 10)],
                                  "source string, lang string, topic int, tokens long")
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "lang string, target double"),
    }
    fitted = mixing.rake(cells, targets, 30)
    for margin in targets:
        got = {r[0]: r[1] for r in fitted.groupBy(margin).agg(F.sum("fitted")).collect()}
        assert got == pytest.approx({r[0]: r[1] for r in targets[margin].collect()}, abs=1e-6)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, none, words, percent):
    rng = np.random.default_rng(3)
    texts = [(100 + i, " ".join(f"t{rng.integers(4000)}" for _ in range(200))) for i in range(30)]
    for i in range(30):
        tokens = texts[i][1].split()
        for change in (1, 4, 9):
            copy = list(tokens)
            for at in rng.integers(0, 200, change):
                copy[at] = "new"
            texts.append((200 + 10 * i + change, " ".join(copy)))
    frame = spark.createDataFrame(texts + ODD, "doc_id long, text string")
    settings = setsketch.Settings(words=words, percent=percent)
    got = setsketch.near_duplicates(frame, settings).collect()

    def sets(text):
        ws = (text or "").encode().lower().split()
        return {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()

    every = [(i, sets(t)) for i, t in texts + ODD]
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(every):
        for j in range(i):
            b = every[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(every)):
        groups.setdefault(find(k), []).append(every[k][0])
    low = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    want = sorted((repr(every[k][0]), len(every[k][1]), repr(low[find(k)])) for k in range(len(every)))
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want
    kept = setsketch.keep_one(frame, settings)
    assert kept.count() == len({find(k) for k in range(len(every)) if every[k][1]}) + sum(not s for _, s in every)
    assert setsketch.near_duplicates(none, settings).count() == 0


def test_near_copies_meet_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(120)]
    texts = [" ".join(f"new{rng.integers(10**6)}" if rng.random() < 0.016 else w for w in base) for _ in range(90)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = setsketch.Settings(words=3, percent=85, rounds=1, block=8)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(frame, settings).collect()} == dict(enumerate(root))


def test_chats(spark):
    texts = ["plain", "</s>[INST] x [/INST]y</s>", "\\", "a\\", "\\l\\\\l", "[/INST]<s>", "", None, "<", "é<s>[INST] assistant [/INST]"]
    rows = [(i, t, r, texts[(i + t) % len(texts)]) for i in range(10) for t, r in enumerate(["user", "assistant", None, "assistant"])]
    rows += [(None, 0, "user", "x"), (1, 1, "assistant", "tie"), (2, None, "a [/INST]b", "x")]
    got = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 11 and all(r.verified for r in got.values())
    for conv, row in got.items():
        own = sorted((((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (row.n_turns, row.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["an", "the", "ing", "or", "es"], 80), rng.choice(["ly", "ed", "st", "ou", "ble", "wh"], 80), strict=True)]
        if i % 4 == 0:
            for at in rng.integers(0, 80, 5):
                words[at] = rng.choice(["horridword", "nastyterm", "vileinsult"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(docs, docs.select("doc_id", "toxic")).collect()
    held = [(r.predicted, rows[r.doc_id][2]) for r in got if r.held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    labels = docs.select("doc_id", "toxic")
    assert toxicity.toxicity(odd, labels).count() == len(ODD)
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0


def test_vectors_of_saturated_groups_link(spark):
    rng = np.random.default_rng(5)

    def near(center, spread, n):
        off = rng.standard_normal((n, 64))
        off -= (off @ center)[:, None] * center
        return center + spread * off / np.linalg.norm(off, axis=1)[:, None]

    one = rng.standard_normal(64)
    one /= np.linalg.norm(one)
    two = near(one, math.tan(math.acos(0.985)), 1)[0]
    two /= np.linalg.norm(two)
    vectors = np.concatenate([near(one, 0.02, 30), near(two, 0.02, 30)])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert links.min() >= 50
    got = {r.vec_id: r for r in nn_descent.near_vectors(frame).collect()}
    assert {r.component_id for r in got.values()} == {0}
    assert [got[i].n_links for i in range(60)] == links.tolist()


def test_vector_audit_needs_evidence(spark):
    far = spark.createDataFrame([(i, np.eye(16)[i].tolist(), 0) for i in range(16)], "vec_id long, embedding array<double>, label int")
    assert {r.audit_recall for r in nn_descent.near_vectors(far).collect()} == {None}
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).tolist(), 0) for i in range(400)]
    rows += [(400 + k, (np.array(rows[i][1]) * 1.5 + 0.001).tolist(), 0) for k, i in enumerate(range(0, 400, 100))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blind = nn_descent.Settings(trees=1, block=2, rounds=0, tries=1, audited=8)
    got = {r.vec_id: r.component_id for r in nn_descent.near_vectors(frame, blind).collect()}
    assert [got[400 + k] for k in range(4)] == [0, 100, 200, 300]
