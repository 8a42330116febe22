"""Operators 1, 6, 8, 9 and 5 against brute force, on awkward rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
import xxhash
from llm_rows import awkward, prose

from tabscout.llm import decontamination, mixing, quality_rules, simhash_dedup, substring_dedup


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def kept_words(rows, window):
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, 1 << 63), 1 << 63 if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (1 << 63 if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup(docs, window):
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeated(docs, window).collect())
    assert got == kept_words([(r[0], r[1]) for r in awkward()], window)


@pytest.mark.parametrize("fan", [2, 3, 6])
def test_substring_dedup_over_levels(spark, fan):
    """Many batches and buckets, so that rows pass two to four levels; one window stands in every document."""
    hot = prose(13, 77)
    rows = [(k, f"{prose(30, k % 50)} {hot} {prose(20, k % 7)}") for k in range(300)] + [(None, hot), (5, hot), (5, prose(30, 5)), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = substring_dedup.remove_repeated(df, 13, batch_bytes=(1000, 1000), bucket_windows=(1200, 1200), fan=fan)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()) == kept_words(rows, 13)


def test_hot_windows_reach_a_bucket_once_a_batch():
    """However many documents of a batch have a passage, its row has each window once."""
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array(range(2000), pa.int64()), "text": [prose(40, 1)] * 2000})
    rows = substring_dedup._emitter(13, 1, 1)((pa.scalar(0),), table)
    assert rows.num_rows == 1 and len(rows.column("hashes")[0].as_py()) == 7 * 28


def thue_morse(n, a="a", b="b"):
    x = a
    flip = str.maketrans(a + b, b + a)
    while len(x) < n:
        x += x.translate(flip)
    return x, x.translate(flip)


@pytest.mark.parametrize("n", [1024, 2048])
def test_long_words_of_two_letters_do_not_meet(spark, n):
    """Words on which any polynomial hash modulo 2**64 collides."""
    one, other = thue_morse(n)
    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}")]
    df = spark.createDataFrame([(d, t, "h") for d, t in rows], "doc_id long, text string, source string")
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeated(df).collect()) == kept_words(rows, 13)
    bench = spark.createDataFrame([(1, f"{one} " + tail)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontamination.contamination(df, bench).collect()} == {1: 13, 2: 12}
    bench = spark.createDataFrame([(1, f"{one} " + " ".join(tail.split()[:9]))], "item_id long, text string")
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(df, bench).collect()} == {1: (10, ["1"]), 2: (0, [])}
    lines = spark.createDataFrame([(1, f"{one}\n{other}\n{one}", "h"), (2, f"{' '.join(one)}\n{' '.join(other)}", "h")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.rules(lines).collect()} == {1: 1, 2: 0}
    spaced = [" ".join(x) for x in (one, other)]
    many = [(k, f"{spaced[k % 2]}\n{prose(60, k)}", "h") for k in range(44)]
    left = {r["doc_id"]: r["words_left"] for r in quality_rules.rules(spark.createDataFrame(many, "doc_id long, text string, source string"), most_documents=30).collect()}
    assert set(left.values()) == {n + 60}


def test_substring_intervals(docs):
    for r in substring_dedup.remove_repeated(docs, 13).collect():
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def fingerprint(text, width=4):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs):
    rows = awkward()
    prints = {(d, t): fingerprint(t) for d, t, *_ in rows}
    label = {f: f for f in prints.values()}
    for a in label:
        for b in label:
            if bin(a ^ b).count("1") <= 4:
                x, y = label[a], label[b]
                for k in label:
                    if label[k] == max(x, y):
                        label[k] = min(x, y)
    smallest = collections.defaultdict(list)
    for (d, _), f in prints.items():
        smallest[label[f]] += [] if d is None else [d]
    expected = collections.Counter((d, prints[d, t], min(smallest[label[prints[d, t]]], default=None)) for d, t, *_ in rows)
    got = collections.Counter((r["doc_id"], r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.components(docs).collect())
    assert got == expected


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL", 5)
    rows = [(i, prose(30, i % 40) + (" x" if i % 2 else "")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.components(df).collect()}
    f = {d: fingerprint(t) for d, t in rows}
    label = dict(zip(f, f))
    changed = True
    while changed:
        changed = False
        for a in f:
            for b in f:
                if bin(f[a] ^ f[b]).count("1") <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    assert got == label


@pytest.mark.parametrize("tile", [1 << 20, 200])
def test_similar_is_exact_around_the_limit(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "TILE_HASHES", tile)
    rng, texts = random.Random(4), []
    for n in (8, 9, 12, 16, 19, 24, 29, 34, 40, 60, 90, 140):
        for k in range(6):  # words put at the end change one shingle each
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(words)] + [" ".join(words + [f"x{rng.randrange(10**9)}" for _ in range(more)]) for more in {max(1, round((n - 4) / s - (n - 4)) + d) for s in (0.72, 0.8) for d in (-1, 0, 1)}]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar(df).collect()} == dict(enumerate(least))


def test_deduplicate_keeps_one_of_each(docs):
    kept = simhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert 1 in ids and not {2, 3, 13} & set(ids) and {7, 8, 9, 10, 12, 14} <= set(ids)
    assert ids.count(4) == 1 and 5 not in ids


def contaminated(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = re.findall(pattern, lower(text)), set(), set()
    for item, t in items:
        v = re.findall(pattern, lower(t))
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


ITEMS = [(1, prose(40, 3)), (2, "Word"), (3, None), (4, ""), (5, prose(12, 5)), (6, "alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta"), (None, prose(15, 13)), (5, prose(12, 5)), (7, "a a a")]


@pytest.mark.parametrize("shard", [16 << 20, 200])
def test_decontamination(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    extra = spark.createDataFrame([(100, "alpha beta " * 30, None, None, 0), (101, "x " + prose(12, 5) + " word. y", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontamination.contamination(rows, bench).collect())
    own = [(d, t) for d, t, *_ in awkward()] + [(100, "alpha beta " * 30), (101, "x " + prose(12, 5) + " word. y")]
    expected = collections.Counter()
    for d, t in own:
        n, h, i = contaminated(t, ITEMS)
        expected[(d, n, h, tuple(i))] += 1
    assert got == expected


def test_decontaminate_passes_on_any_columns(spark, monkeypatch):
    """Names that the operator uses inside, in one shard and in many."""
    names = ["row", "row_", "hits", "items", "marked_items", "marked_hits", "item", "shard"]
    df = spark.createDataFrame([(1, prose(12, 5) + " and so on for quite a while after that, until the end of it all", *range(8)), (1, "clean", *range(8)), (None, None, *[None] * 8)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    bench = spark.createDataFrame([(k, prose(12, 5 + k)) for k in range(4)], "item_id long, text string")
    for shard in (1 << 24, 50):
        monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
        out = decontamination.decontaminate(df, bench)
        assert out.columns == df.columns
        assert {(r["doc_id"], r["text"], *(r[n] for n in names)) for r in out.collect()} == {(1, " and so on for quite a while after that, until the end of it all", *range(8)), (1, "clean", *range(8)), (None, None, *[None] * 8)}


@pytest.mark.parametrize("shard", [1 << 24, 200])
def test_decontaminate_does_not_depend_on_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
    w = [f"w{k}" for k in range(400)]
    items = [" ".join(w[15 * k : 15 * k + 20]) for k in range(20)]  # each overlaps the next by 5 words
    bench = spark.createDataFrame([(f"b{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    half = [x for k in (0, 10) for x in [*w[15 * k : 15 * k + 20], *(f"o{k}x{j}" for j in range(14))]]  # 40 of 68, by two items
    overlap = ["a", *w[30:50], *w[50:65], *(f"p{j}" for j in range(60))]
    apart = [*(f"q{j}" for j in range(60)), *w[200:205], *w[90:110], *w[205:210], "end"]  # cutting joins half windows
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((half, overlap, apart))] + [(3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(df, bench).collect()}
    hits = {r["doc_id"]: r["n_hit"] for r in decontamination.contamination(df, bench).collect()}
    assert hits == {0: 40, 1: 35, 2: 20, 3: 0, 4: 0}
    assert got == {1: " ".join(["a", "", *overlap[36:]]), 2: " ".join([*apart[:65], "", *apart[85:]]), 3: None, 4: ""}


def test_decontaminate_cuts_spans(spark):
    rows = [(1, "Before, " + prose(12, 5) + "! After that there is a good deal more of it, enough to stay in the corpus as a text."), (2, prose(12, 5)), (3, "clean"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, prose(12, 5))], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(df, bench).collect()}
    assert got == {1: "Before, ! After that there is a good deal more of it, enough to stay in the corpus as a text.", 3: "clean", 4: None, 5: ""}


def test_quality_rules_base(docs):
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.rules(docs).collect())
    expected = collections.Counter()
    for d, t, *_ in awkward():
        w = words(t)
        wins = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {p for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        expected[(d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))] += 1
    assert got == expected


def test_frequent_lines_deplete(spark):
    """Documents that are nothing but a host's frequent lines go; others lose only those lines."""
    shared = "\n".join(prose(20, 100 + k) for k in range(3))
    rows = [(i, shared + f"\nread {i:02d} times {i:02d}", "h") for i in range(40)] + [(100 + i, prose(80, i) + "\n" + shared.split("\n")[0], "h") for i in range(40)] + [(200, shared, "other")]
    got = {r["doc_id"]: (r["words_left"], r["kept"]) for r in quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (0, False) for i in range(40))
    assert all(got[100 + i] == (80, True) for i in range(40))
    assert got[200] == (60, True)


def test_mixing_hits_budgets(docs):
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source_size"], r["target"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size and sum(r["taken"] for r in own) == int(target) and target <= 2 * size
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixing_takes_by_brute_force(spark, docs):
    """Every row's words, from the sorted keys, the running sum and the cut."""
    rows = awkward()
    keys = {d: int(hashlib.md5(f"{mixing.SEED}:{'null' if d is None else d}".encode()).hexdigest()[:15], 16) for d in {r[0] for r in rows}}
    target = {r["source_size"]: r["target"] for r in mixing.mix(docs).collect()}
    sources = collections.defaultdict(list)
    for d, t, _, source, _ in rows:
        sources[source].append((keys[d], d is None, d or 0, len(words(t)), d))
    expected = collections.Counter()
    for own in sources.values():
        size = sum(x[3] for x in own)
        budget, done = int(target[size]), 0
        epochs = budget // size if size else 0
        rest = budget - epochs * size
        for *_, n, d in sorted(own, key=lambda x: x[:4]):
            expected[d, n, size, epochs * n + max(0, min(n, rest - done))] += 1
            done += n
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mixing.mix(docs).collect()) == expected


def test_targets_water_filling(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 1, None: 50, "e": 0}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = dict(zip(names, [3, 1, 2] * 2))
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())
    expected = full | share
    assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-9 for s in names)


@pytest.mark.parametrize("run", [
    lambda d, s: substring_dedup.remove_repeated(d), lambda d, s: simhash_dedup.components(d), lambda d, s: simhash_dedup.similar(d), lambda d, s: quality_rules.rules(d), lambda d, s: mixing.mix(d),
    lambda d, s: decontamination.contamination(d, s.createDataFrame([], "item_id long, text string")),
])
def test_empty_tables(spark, nothing, run):
    assert run(nothing, spark).collect() == []


def test_empty_benchmark(spark, docs):
    got = decontamination.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(awkward()) and all(r["n_hit"] == 0 and r["items"] == [] for r in got)


def test_hash_of_kept_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
