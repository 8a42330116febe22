"""Operators 2, 3, 4, 7 and 10, and the pipeline, on small rows with known answers."""

import collections
import hashlib
import re
import zlib

import pytest
from llm_rows import awkward, prose
from pyspark.sql import functions as F

import corpus_pipeline
from tabscout.llm import chat, pii, quality_classifier, toxicity, warc

FORMS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(FORMS):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m.group() if "0" <= c <= "9"]
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PRIVATE = [
    "a@b.com_foo@bar.co.uk a@b x.y@z-1.org. @ a@b.c.d..e", "1.2.3.4.5 255.255.255.255 256.1.1.1 0001.02.3.4 1.2.3 999999999999999999999999999999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 411111111111",
    "+1 (499) 555-6503. +49 30 1234567 +1 +12 +1-2-3 +1234567890123456", "é 🙂 mail: ü.x@y.de 🙂 +1 (499) 555-6503", "5 5 5 5  5-5-5--5 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "1" * 5000 + " " + "a" * 5000, "", None,
    "x@y.z" * 50, "0-0 0-0 0-0 0-0 0-0 0-0 0-0", "+1 .()-9 +1.2.3.4.5.6.7.8.9.0",
]


def test_pii_base_is_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(PRIVATE)]
    got = {r["doc_id"]: r["s"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(pii.base(F.col("__spans"))).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}
    assert pii.find(docs).count() == len(awkward())


def test_pii_patterns_find_more(spark):
    rows = [(i, f"Some words here, customer number 10.0.0.{i} was seen today.") for i in range(6)] + [(10 + i, f"Some words here, customer number KX-{i}4471{i} was seen today.") for i in range(3)] + [(20, "In the year 2019 we sold 1200345 of them.")]
    rows += [(30 + i, f"nothing of this sort: ask anna.{i}@example.org, please") for i in range(4)] + [(40, "nothing of this sort: ask 99-kl-77123, please")]
    got = {r["doc_id"]: r["s"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("__spans")).alias("s")).collect()}
    assert all(got[10 + i].startswith("found:33:") for i in range(3)) and got[40].startswith("found:") and got[20] == ""


def test_pii_contexts_and_chains_have_no_end(spark):
    """Context words that stand far away, and patterns that are only believed after several rounds."""
    far = " " * 300
    rows = [(k, f"customer{far}number{far}10.0.0.{k} seen") for k in range(6)] + [(10 + k, f"customer{far}number{far}KX-{k}4471{k} seen") for k in range(3)]
    for hop, c in enumerate("abcdefg"):  # in each context stand the instances of its own hop and those of the next
        for k in range(20):
            for own in (hop, hop + 1):
                rows.append((1000 * (hop + 1) + 100 * (own - hop) + k, f"of {c}first {c}second {f'10.9.8.{k}' if own == 0 else f'QQ-{own}88{k:02d}'} {c}third"))
    got = {r["doc_id"]: r["s"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("__spans")).alias("s")).collect()}
    assert all("found:" in got[10 + k] for k in range(3))
    assert all("found:" in got[1000 * (hop + 1) + 100 + k] for hop in range(7) for k in range(20))


def test_pii_many_matches_in_one_text(spark):
    """Places over many blocks of matches."""
    text = " ".join(f"a{k}@x.org {k % 256}.1.2.{k % 300} +1 (499) 555-{1000 + k}" for k in range(3000))
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed(pii.base(F.col("__spans"))).alias("s")).first()
    assert r["s"] == base_spans(text)


def test_pii_passes_on_any_columns(spark):
    df = spark.createDataFrame([(1, "me@x.org", "a", "b", "c")], "doc_id long, text string, __spans_ string, __row string, __own string")
    assert pii.redact(df).collect()[0].asDict() == {"doc_id": 1, "text": "[EMAIL]", "__spans_": "a", "__row": "b", "__own": "c"}
    with pytest.raises(ValueError, match="__spans"):
        pii.find(df.withColumnRenamed("__row", "__spans"))
    assert pii.redact(df.withColumnRenamed("__row", "__spans")).columns == ["doc_id", "text", "__spans_", "__spans", "__own"]


def test_redact(spark):
    rows = [(1, "Ask me@x.org or +1 (499) 555-6503."), (2, None), (3, ""), (4, "clean")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Ask [EMAIL] or [PHONE].", 2: None, 3: "", 4: "clean"}


PAGES = [(3, "u", "x" * 200), (1, "u?a=1 2", "x" * 200), (2, None, "x" * 200), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "é%<>\r\n", "WARC/1.1\r\n\r\n" + "é" * 100), (8, "u", "y" * 400_000), (1, "u", "x" * 200)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = warc.bundles(pages).cache()
    got = sorted((int(r["record_id"]), r["uri"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in warc.records(archives).collect())
    expected = []
    for p, u, h in PAGES:
        body = (h or "").encode()
        again = h == "x" * 200 and p != 1
        expected.append((p, u or "", len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", "1" if again else None, b"" if again else body))
    assert got == sorted(expected)
    found = warc.lookup(archives, ["8", "2"]).collect()
    assert sorted(r["record_id"] for r in found) == ["2", "8"] and {len(r["payload"]) for r in found} == {0, 400_000}


def test_warc_files_are_read_by_range(spark, tmp_path, docs):
    """Real files: each ends in its seek table, and a record costs its frame, even if the rest of the file is spoilt."""
    pages = spark.createDataFrame([(k, "u", prose(4000, k)) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    index = warc.bundles(pages, folder=str(tmp_path / "archives"))
    row = index.where("record_id = '31'").first()
    assert row["path"].endswith(".warc.zst") and row["frame_bytes"] < 200_000
    with open(row["path"], "r+b") as f:
        data = f.read()
        reader = warc.BundleReader(data)
        assert len(reader.frames) > 3 and row["frame_start"] in [x[0] for x in reader.frames]
        f.seek(0)
        f.write(b"\0" * row["frame_start"] + data[row["frame_start"] : row["frame_start"] + row["frame_bytes"]])
        f.truncate()
    found = warc.lookup(index, ["31"]).collect()
    assert [(r["record_id"], bytes(r["payload"]).decode()) for r in found] == [("31", prose(4000, 31))]
    out = warc.records(warc.bundles(docs, "doc_id", "source", "text")).collect()  # nulls, repeats, long texts and clashing names
    assert sorted(r["record_id"] for r in out) == sorted("null" if d is None else str(d) for d, *_ in awkward())


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from tabscout.llm import shared

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        pass

    one = Session()
    one.conf = Conf(**{"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(one)
    one.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y"})
    assert shared.shared_folder(one) == "hdfs://x/y"
    assert shared.filesystem("file:/a/b")[1] == shared.filesystem("file:///a/b")[1] == shared.filesystem("/a/b")[1] == "/a/b"


def test_warc_seek_table():
    w = warc.BundleWriter()
    for k in range(50):
        w.add(str(k), warc.record(str(k), "u", b"z" * 20_000, 20_000, "d", None))
    _, content, index = w.close()
    reader = warc.BundleReader(content)
    assert len(reader.frames) > 2 and sum(f[1] for f in reader.frames) < len(content)
    assert all(reader.read(r["frame"], r["offset"])[0]["WARC-Record-ID"] == f"<urn:record:{r['record_id']}>" for r in index)
    import zstandard

    plain = b"".join(zstandard.ZstdDecompressor().decompress(content[a : a + b]) for a, b, _ in reader.frames)
    assert plain.count(b"WARC/1.1\r\n") == 50


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\\n"), (2, 5, "system", None), (2, 7, None, "\\<|\\\\|"), (3, 1, "assistant", ""), (3, 0, "as\nsistant\\", "é🙂"), (None, 0, "assistant", "no id"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.chains(df)).select("tree", "n_turns", chat.read_back(F.col("conversation")).alias("t"), chat.trained_text(F.col("conversation"), F.col("loss")).alias("l")).collect()
    expected = collections.defaultdict(list)
    for c, n, r, t in sorted(TURNS, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or "", x[3] or "")):
        expected[c].append((r or "", t or ""))
    assert {r["tree"]: [tuple(x) for x in r["t"]] for r in out} == dict(expected)
    assert {r["tree"]: r["l"] for r in out} == {c: "".join(t for r, t in v if r == "assistant") for c, v in expected.items()}


def test_reply_tree_paths(spark):
    """         1          9 and 10 form a cycle, 11 hangs below it; 12's parent is missing.
              2   3
             4 5  6"""
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 1.0), ("t", 5, 2, 9.0), ("t", 6, 3, 1.0), ("t", 9, 10, 99.0), ("t", 10, 9, 99.0), ("t", 11, 10, 99.0), ("u", 12, 77, 1.0), (None, 1, None, None), (None, 2, 1, None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    every = collections.defaultdict(list)
    for r in chat.paths(df, None).orderBy(F.desc("up")).collect():
        every[r["tree"], r["leaf"]].append(r["node"])
    assert every == {("t", 4): [1, 2, 4], ("t", 5): [1, 2, 5], ("t", 6): [1, 3, 6], ("u", 12): [12], (None, 2): [1, 2]}
    best = {(r["tree"], r["leaf"]) for r in chat.paths(df, 1).collect()}
    assert best == {("t", 5), ("u", 12), (None, 2)}
    assert {r["leaf"] for r in chat.paths(df, 2).where("tree = 't'").collect()} == {5, 6}


def test_ranking_does_not_make_every_path(spark, monkeypatch):
    """A chain with a leaf at every node: the rows written for the best path grow with the nodes, not with their square."""
    n, written = 300, []
    nodes = [("t", k, k - 1 if k else None, 1.0) for k in range(n)] + [("t", n + k, k, 0.5) for k in range(n)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    real = chat.written
    monkeypatch.setattr(chat, "written", lambda d, name: (out := real(d, name), written.append(out.count()))[0])
    best = sorted(r["node"] for r in chat.paths(df, 1).collect())
    assert best == [*range(n), 2 * n - 1] and max(written) <= 2 * n
    scores = {}
    for r in chat.paths(df, 3).collect():
        scores[r["leaf"]] = scores.get(r["leaf"], 0) + (1.0 if r["node"] < n else 0.5)
    assert scores == {2 * n - 1: n + 0.5, 2 * n - 2: n - 0.5, 2 * n - 3: n - 1.5}


def test_chat_on_awkward_rows(spark, docs):
    """Nulls, repeated rows, long texts, and columns whose names are used inside."""
    rows = docs.withColumn("tree", F.lit("x")).withColumn("leaf", F.lit(3)).withColumn("t", F.lit(None).cast("string"))
    out = chat.formatted(chat.chains(rows, "source", "doc_id", "lang", "text")).select("tree", "n_turns", chat.read_back(F.col("conversation")).alias("x")).collect()
    expected = collections.defaultdict(list)
    for d, t, lang, source, _ in sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[2] or "", r[1] or "")):
        expected[source].append((lang or "", t or ""))
    assert {r["tree"]: sorted(map(tuple, r["x"])) for r in out} == {k: sorted(v) for k, v in expected.items()}


def test_long_chain(spark):
    df = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.formatted(chat.chains(df)).first()
    assert r["n_turns"] == 700 and len(r["loss"]) == 350
    assert [r["conversation"][s["start"] : s["end"]] for s in r["loss"]] == [str(k) for k in range(1, 700, 2)]


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts say a bad word; low quality ones are shouted repetition."""
    docs, labels = [], []
    for k in range(400):
        toxic, low = k % 5 == 0, k % 3 == 0
        t = prose(90, k + 1)
        t = t.replace(t.split()[10], "nastyword", 1) + (" nastyword" if k % 2 else "") if toxic else t
        docs.append((k, " ".join([t.upper()] * 3) + " !!! ###" if low else t))
        labels.append((k, 0 if low else 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "   "), (None, prose(50, 2)), (None, "nastyword here")]
    labels += [(1000, None, None), (7, 1, 0), (5555, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(spark, mod, rest):
    return F.pmod(quality_classifier.crc(), F.lit(mod)) == rest


def test_crc(spark):
    assert [r[0] for r in spark.range(50).select(quality_classifier.crc("id")).collect()] == [zlib.crc32(str(k).encode()) for k in range(50)]


def test_toxicity_scores(spark, labelled):
    docs, labels = labelled
    out = toxicity.scores(docs, labels, ~held(spark, 4, 2)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    score = {r["doc_id"]: r["score"] for r in out if r["doc_id"] is not None}
    assert all((score[k] >= 0.3) == (k % 5 == 0) for k in range(400)) and all(score[k] < 0.3 for k in (1000, 1001, 1002))
    evidence = {r["doc_id"]: r["evidence"] for r in out}
    assert evidence[10] and all(e % 5 == 0 for e in evidence[10])
    kept = toxicity.keep_clean(docs, labels, ~held(spark, 4, 2))
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {k for k in range(400) if k % 5} | {1000, 1001, 1002}


def test_toxicity_drops_only_copies(spark):
    shared = "one passage that very many texts of the table share word for word"
    own = [f"{shared} {prose(60, k + 1)}" for k in range(40)]
    rows = [(k, t, float(k % 2)) for k, t in enumerate(own)]
    long = own[2] + " " + prose(60, 90)
    rows += [(100, own[3], 1.0), (101, own[3], 0.0), (102, long, 0.0), (103, long + " end", 0.0), (104, long + " end", 1.0), (105, "", 1.0), (106, None, 1.0), (107, " ", 0.0), (108, "a b", 0.0), (109, "a b", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double").repartition(4)
    kept = toxicity._without_copies(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in rows} - {100, 103, 106, 109})


def brute_terms(text):
    """Words and beginnings of words, each at the levels that its count reaches."""
    import math

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = collections.Counter(words)
    for w in words:
        b = w.encode()
        n.update((k, b[:k]) for k in toxicity.STEMS if len(b) > k)
    return {(t, level): 1 + math.log(c) for t, c in n.items() for level in toxicity.LEVELS if c >= level}


@pytest.mark.parametrize("gain", [True, False])
def test_neighbours_are_brute_force_over_all_terms(spark, gain):
    """Cosines over the examples' whole vocabulary: evidence and votes of every text that shares any term with an example."""
    import math

    texts = [f"{prose(12 + k % 30, k)} {'nasty' * (k % 4 == 0)} end{k % 3}ing" for k in range(160)] + ["", None, "???", "strange alpha1", "NASTY nasty"]
    ids = list(range(len(texts)))
    y = {k: int(k % 4 == 0) for k in range(0, 160, 2)}
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    vectors, every = {k: brute_terms(t) for k, t in zip(ids, texts)}, collections.Counter()
    for v in vectors.values():
        every.update(v.keys())
    vocabulary = {t for k in y for t in vectors[k]}
    weight = {t: math.log((1 + len(ids)) / (1 + every[t])) + 1 for t in vocabulary}
    if gain:
        n1, n0 = sum(y.values()), len(y) - sum(y.values())
        for t in vocabulary:
            a = sum(t in vectors[k] for k in y if y[k])
            b = sum(t in vectors[k] for k in y if not y[k])
            c, d = n1 - a, n0 - b
            chi = (a * d - b * c) ** 2 * (n1 + n0) / ((a + b) * (c + d + 1) * n1 * n0)
            more = max(chi - toxicity.LEAST_CHI, 0) if a * n0 > b * n1 else 0
            weight[t] *= toxicity.FLOOR + more / (toxicity.HALF_CHI + more)

    def unit(v):
        v = {t: x * weight[t] for t, x in v.items() if t in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units = {k: unit(v) for k, v in vectors.items()}
    got = {r["doc_id"]: r for r in toxicity.scores(docs, labels, F.lit(True), gain=gain).collect()}
    votes = {}
    for k in ids:
        cosine = {e: sum(x * units[e].get(t, 0) for t, x in units[k].items()) for e in y}
        near = sorted((e for e in y if cosine[e] > 0), key=lambda e: (-round(min(cosine[e], 1), 5), e))
        assert got[k]["evidence"] == near[: toxicity.EVIDENCE], k
        kth = sorted(cosine.values())[-toxicity.NEIGHBOURS]
        near = [e for e in near if cosine[e] >= kth - toxicity.TIE]
        w = {e: 1 / (1.05 - round(min(cosine[e], 1), 5)) for e in near}
        votes[k] = sum(w[e] * y[e] for e in near) / sum(w.values()) if near else None
    assert votes[160] is votes[161] is votes[162] is None and got[163]["evidence"]
    known = sorted((v, got[k]["score"]) for k, v in votes.items() if v is not None)
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(known, known[1:]))  # the score is a non-decreasing function of the vote
    by = collections.defaultdict(set)
    for v, score in known:
        by[round(v, 9)].add(round(score, 9))
    assert all(len(x) == 1 for x in by.values())


def test_quality_scores(spark, labelled):
    docs, labels = labelled
    out = quality_classifier.scores(docs, labels, ~held(spark, 5, 0)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    score = {r["doc_id"]: r["score"] for r in out if r["doc_id"] is not None}
    assert all((score[k] >= 0.5) == (k % 3 != 0) for k in range(400))


def isotonic(points):
    """Pooling, one pair at a time, until nothing violates the order."""
    blocks = [[x, y, w] for x, y, w in sorted(points)]
    k = 0
    while k < len(blocks) - 1:
        a, b = blocks[k], blocks[k + 1]
        if a[1] >= b[1]:
            w = a[2] + b[2]
            blocks[k : k + 2] = [[(a[0] * a[2] + b[0] * b[2]) / w, (a[1] * a[2] + b[1] * b[2]) / w, w]]
            k = max(k - 1, 0)
        else:
            k += 1
    return blocks


def brute_statistics(text):
    import math

    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    wins = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {p for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    solid, n, chars, m = sum(map(len, w)), max(len(w), 1), max(len(t), 1), max(len(lines), 1)
    count = lambda s: sum(c in s for c in t)
    return [
        math.log1p(len(w)), min(solid / n, 50), count("#*$%&|<>") / chars, count("0123456789") / chars, sum("A" <= c <= "Z" for c in t) / chars, count(".,;:!?") / n, count(".!?") / n, (len(lines) - len(set(lines))) / m, len(rep) / n,
        len(set(w)) / n, math.log1p(len(w) / m), solid / chars, math.log1p(len(t)),
    ]


def test_quality_scores_are_brute_force(spark, labelled):
    """Statistics, features, folds, ridge and calibration, all in one process and one matrix."""
    import numpy as np

    q = quality_classifier
    docs, labels = labelled
    got = {(r["doc_id"]): r["score"] for r in q.scores(docs, labels, ~held(spark, 5, 0)).collect()}
    texts = docs.collect()
    own = {r["doc_id"]: r["quality"] for r in labels.where(~held(spark, 5, 0)).collect() if r["quality"] is not None and r["doc_id"] is not None and r["doc_id"] != 7}
    seven = [r["quality"] for r in labels.where(~held(spark, 5, 0) & (F.col("doc_id") == 7)).collect()]
    if seven:
        own[7] = int(sum(seven) / len(seven) >= 0.5)
    fold = {r["d"]: r["f"] for r in spark.createDataFrame([(r["doc_id"],) for r in texts], "d long").selectExpr("d", f"int(pmod(xxhash64(d, {q.SEED}), {q.FOLDS})) AS f").collect()}
    x = np.array([brute_statistics(r["text"]) for r in texts])
    train = np.array([r["doc_id"] in own for r in texts])
    y, folds = np.array([float(own.get(r["doc_id"], 0)) for r in texts]), np.array([fold[r["doc_id"]] for r in texts])
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
    scale[scale <= 1e-9 * np.abs(mean)] = 1
    rng = np.random.default_rng(q.SEED)
    direction, phase = rng.standard_normal((x.shape[1], q.FEATURES)) / q.WIDTH, rng.uniform(0, 2 * np.pi, q.FEATURES)
    z = np.hstack([np.sqrt(2 / q.FEATURES) * np.cos(np.clip((x - mean) / scale, -4, 4) @ direction + phase), np.ones((len(x), 1))])

    def ridge(rows):
        penalty = np.full(z.shape[1], max(rows.sum(), 1) * q.RIDGE)
        penalty[-1] = 1e-9
        return np.linalg.solve(z[rows].T @ z[rows] + np.diag(penalty), z[rows].T @ y[rows])

    unseen = np.zeros(len(x))
    for k in range(q.FOLDS):
        unseen[folds == k] = z[folds == k] @ ridge(train & (folds != k))
    bins = collections.defaultdict(list)
    for r, label in zip(unseen[train], y[train]):
        bins[int(np.floor(np.clip(r, -0.5, 1.5) * q.BINS / 2))].append((r, label))
    blocks = isotonic([(np.mean([r for r, _ in v]), np.mean([label for _, label in v]), len(v)) for v in bins.values()])
    expected = np.clip(np.interp(z @ ridge(train), [b[0] for b in blocks], [b[1] for b in blocks]), 0, 1)
    assert all(abs(got[r["doc_id"]] - e) < 1e-6 for r, e in zip(texts, expected) if r["doc_id"] is not None)


def test_scorers_on_awkward_rows(spark, docs):
    """Nulls, ties, repeated rows, long texts and clashing names: a score for every row, the same for the same text."""
    labels = spark.createDataFrame([(d, d % 2, int(d % 3 == 0)) for d in range(1, 15)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_classifier):
        out = module.scores(docs, labels, F.lit(True)).collect()
        assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(d for d, *_ in awkward()) and all(0 <= r["score"] <= 1 for r in out)
        by = collections.defaultdict(set)
        for r in out:
            by[r["doc_id"]].add(round(r["score"], 12))
        assert len(by[13]) == 1 and by[1] == by[2] == by[13]
    kept = toxicity.keep_clean(docs, labels, F.lit(True))
    assert kept.columns == docs.columns


def test_scores_without_labels(spark, labelled):
    docs, labels = labelled
    none = labels.where("false")
    assert {r["score"] for r in quality_classifier.scores(docs, none, F.lit(True)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scores(docs, none, F.lit(True)).collect()} == {0.0}
    one = labels.where("toxic = 1 AND doc_id < 400")
    assert {r["score"] for r in toxicity.scores(docs, one, F.lit(True)).collect()} == {1.0}


def test_empty_tables(spark, nothing, labelled):
    _, labels = labelled
    for df in (pii.find(nothing), pii.redact(nothing), toxicity.scores(nothing, labels, F.lit(True)), quality_classifier.scores(nothing, labels, F.lit(True)), warc.records(warc.bundles(spark.createDataFrame([], "page_id long, url string, html string"))), chat.formatted(chat.chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))):
        assert df.collect() == []


def test_pipeline_stages(spark, tmp_path, docs):
    """Every stage takes awkward rows and the empty table, and each keeps clean documents."""
    d = str(tmp_path)
    labels = spark.createDataFrame([(1, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(15, 13))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    ids = {r["doc_id"] for r in out.collect()}
    assert {1, 8, 14} <= ids and not {2, 3} & ids
    stage = spark.read.parquet(f"{d}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, d)
        assert stage.columns == list(corpus_pipeline.COLUMNS), name
    empty = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, d).collect() == []
