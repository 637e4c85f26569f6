"""Operators against brute force on small corpora with odd cases."""

import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alertweave.llm import centroids, decontamination, divergence, graphs, lines, neardup, packing, quality, sharding, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = {"n_words": 5, "kept": 6, "shard": 7, "size": 8, "words": 9, "component_id": 1, "score": 2, "hits": 3, "spans": 4}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_quality_counts_and_verdicts(corpus):
    found = {r["doc_id"]: r for r in quality.quality_verdicts(corpus(), carry=["doc_id", "lang", "source"]).collect()}
    assert len(found) == len(corpus.rows)
    for doc_id, text, *_ in corpus.rows:
        words = WORD.findall(text or "")
        full = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        places = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
        want = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(places), failed)
        r = found[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and failed)
        if text and "|" in text:
            assert not r["kept"]
    assert sum(r["kept"] for r in found.values()) > 50


def test_line_dedup(corpus):
    sites, first = defaultdict(set), {}
    for doc_id, text, _, source, _ in corpus.rows:
        for at, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                sites[line].add(source)
                first.setdefault(line, (doc_id, at))
    found = {r["doc_id"]: r for r in lines.dedup_lines(corpus(CLASHES), min_sites=10, counts=True).collect()}
    removed = 0
    for doc_id, text, *_ in corpus.rows:
        left = []
        for at, line in enumerate((text or "").split("\n")):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if not bare or len(sites[bare]) < 10 or first[bare] == (doc_id, at):
                left.append(line)
        want = None if text is None else "\n".join(left)
        assert found[doc_id]["text"] == want
        assert found[doc_id]["n_chars"] == (None if text is None else len(want)) and found[doc_id]["kept"] == 6
        removed += found[doc_id]["n_removed"]
    assert removed > 10


def test_line_dedup_near_threshold(spark):
    rows = [(i, f"spread over {k} sites", f"site{i % k}") for k in range(5, 16) for i in range(1000 * k, 1000 * k + 2 * k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r["text"] for r in docs.join(lines.dedup_lines(docs, 10).where("text = ''").select("doc_id"), "doc_id").collect()}
    assert gone == {f"spread over {k} sites" for k in range(10, 16)}


def brute_components(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        words = WORD.findall(lower(text))
        k = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(corpus):
    want = brute_components(corpus.rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(corpus(CLASHES)).collect()}
    assert found == want
    assert len({c for _, c in want.values()}) < len(want) - 14
    left = {r["doc_id"] for r in neardup.without_near_duplicates(corpus()).collect()}
    assert left == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_branch_below_the_root(spark, corpus, monkeypatch):
    """With small limits the trees go down several levels and the links stay the same."""
    monkeypatch.setattr(neardup, "PAIRS_PER_SET", 0)
    monkeypatch.setattr(neardup, "LEVELS", 3)
    passage = corpus.passage
    more = [(1000 + i, f"{passage} {' '.join(f'own{i}w{k}' for k in range(12 + i))}", "en", "s", 0) for i in range(12)]
    want = brute_components([*corpus.rows, *more])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(corpus(more=more)).collect()}
    assert found == want


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " x"), (None, None), (7, "")], "doc_id long, text string")
    found = sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert found == [(False, 4, 36, 4), (False, 4, 36, 4), (False, 7, 0, 7), (False, 9, 37, 4)]


@pytest.mark.parametrize("shards", [8, 3])
def test_shards(corpus, shards):
    found = sharding.shard_records(corpus({"slot": 3, "words": 1}), shards=shards).collect()
    assert len(found) == len(corpus.rows)
    by = defaultdict(list)
    for r in found:
        data = (dict((d, t) for d, t, *_ in corpus.rows)[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / shards) <= largest + 1


def test_shards_split_a_hot_text(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    found = sharding.shard_records(docs).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    sizes = [r["b"] for r in found]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 200 and all(r["m"] == r["n"] - 1 for r in found)


def test_packing_round_trip(corpus):
    odd = [(2000 + i, t, "en", "s", 0) for i, t in enumerate(["a  b", "a   b ", " lead", "x\n  y\n \nz ", "it's we'll  ok", "<|endoftext|> plain", "tab\t \tend\n", "é   b"])]
    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    found = packing.pack_documents(corpus(CLASHES, more=odd), path, size=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    rows = [*corpus.rows, *odd]
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
        padding += 256 - at
    assert padding < 256 * 4


def test_fill_prefers_cheap_sequences():
    pieces = [(("d", 0), 0, np.zeros(n, "<u4")) for n in (60, 50, 40, 30, 20)]
    placed, left = packing.fill(pieces, 2, 100, 1.0, 0.01)
    assert not left
    assert [(len(p[2]), s) for p, s, _ in placed] == [(60, 0), (50, 1), (40, 1), (30, 0), (10, 1), (10, 0)]


def test_decontamination(spark, corpus):
    items = [(1, corpus.passage), (2, "one two"), (3, "nothing of this is met here at all in any text so it stays"), (4, None), (5, ""), (None, corpus.passage[30:150]), (1, corpus.passage), (6, "a a a a a a a a a a a a")]
    items.append((7, "ONE, two!"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    found = {r["doc_id"]: r for r in decontamination.contamination(corpus(CLASHES), bench).collect()}
    hits = 0
    for doc_id, text, *_ in corpus.rows:
        own, hit, met = words(text), set(), set()
        for item_id, other in items:
            item = words(other)
            k = min(10, len(item))
            windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
            for i in range(len(own) - k + 1 if k else 0):
                if tuple(own[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    met |= {str(item_id)} if item_id is not None else set()
        r = found[doc_id]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(own), len(hit), sorted(met), bool(hit))
        hits += bool(hit)
    assert hits >= 5
    left = {r["doc_id"] for r in decontamination.without_contaminated(corpus(), bench).collect()}
    assert left == {i for i, r in found.items() if not r["contaminated"]}


def test_suffix_dedup(corpus):
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(corpus(CLASHES)).collect()}
    check_spans(found, corpus.rows)


def test_suffix_dedup_spreads_frequent_grams(corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "FREQUENT", 2)
    monkeypatch.setattr(suffixes, "_CHUNK", 1000)
    more = [(3000 + i, f"{'q' * i}{corpus.passage[:140]}{'z' * (20 - i)}", "en", "s", 0) for i in range(20)]
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(corpus(more=more)).collect()}
    check_spans(found, [*corpus.rows, *more])


def test_suffix_dedup_deals_frequent_strings_evenly(corpus, monkeypatch, tmp_path):
    """Strings of frequent grams go to all buckets, and of equal ones in a block of documents only the first goes."""
    monkeypatch.setattr(suffixes, "FREQUENT", 2)
    folder, sorted_rows = str(tmp_path), suffixes._repeats

    def counted(batches):
        batches = list(batches)
        Path(folder, uuid.uuid4().hex).write_text(str(sum(b.num_rows - b.column(7).null_count for b in batches)))
        yield from sorted_rows(iter(batches))

    monkeypatch.setattr(suffixes, "_repeats", counted)
    words = np.random.default_rng(8).integers(97, 123, (40, 300), np.uint8)
    # one passage between different ones, and many passages each in a few places
    more = [(3000 + i, f"{w.tobytes().decode()[: 60 + i]} {corpus.passage[:160]} {w.tobytes().decode()[60 + i :]}", "en", "s", 0) for i, w in enumerate(words)]
    more += [(4000 + i, f"{i:09d}{words[(i * 7) % 40].tobytes().decode()[100:240]}{i:09d}", "en", "s", 0) for i in range(120)]
    docs = corpus(more=more).coalesce(1)
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    check_spans(found, [*corpus.rows, *more])
    read = sorted(int(p.read_text()) for p in tmp_path.iterdir())
    assert len(read) > 2 and read[-1] < 0.6 * sum(read)


def test_suffix_dedup_spreads_one_gram(spark, monkeypatch, tmp_path):
    """Anchors of one gram that fills whole ranges go to all of them."""
    sizes = str(tmp_path)
    classified = suffixes._classified

    def counted(batches):
        batches = list(batches)
        Path(sizes, uuid.uuid4().hex).write_text(str(sum(b.num_rows for b in batches)))
        yield from classified(iter(batches))

    monkeypatch.setattr(suffixes, "_classified", counted)
    passage = "".join(f"{i:02d}, " for i in range(25))
    rows = [(i, passage) for i in range(400)]
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check_spans(found, rows)
    read = sorted(int(p.read_text()) for p in tmp_path.iterdir())
    assert sum(read) == 400 and read[-1] < 200


def test_suffix_dedup_same_row_twice(corpus):
    """Of rows equal in doc_id and text neither is earlier."""
    twice = (-5, f"{'v' * 70}{corpus.passage[:160]}{'w' * 70}", "en", "s", 0)
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(corpus(more=[twice, twice])).collect()}
    check_spans(found, [*corpus.rows, twice])


def test_suffix_dedup_first_strings():
    met = suffixes.FirstStrings()
    for place in [(5, 1, 9), (5, 1, 4), (7, 2, 0), (3, 6, 8), (3, 9, 2), (3, 6, 8)]:
        met.add(b"a", *place)
    assert met.first == {b"a": (3, 6, 8)} and met.apart == [(b"a", (3, 9, 2))]
    assert sorted(met.gone) == [(5, 1, 4), (5, 1, 9), (7, 2, 0)]


def check_spans(found, rows):
    seen, total = set(), 0
    for doc_id, text, *_ in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            else:
                seen.add(data[at : at + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        r = found[doc_id]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        total += sum(gone)
    assert total > 1000


def test_multikey_order():
    rng = np.random.default_rng(3)
    tokens = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(5)]
    rank = rng.permutation(500)
    order, starts = suffixes.multikey_order(tokens, rank)
    rows = list(zip(*(t.tolist() for t in tokens)))
    got = [rows[i] for i in order]
    runs = np.flatnonzero(starts).tolist() + [500]
    assert all(len(set(got[a:b])) == 1 and list(rank[order[a:b]]) == sorted(rank[order[a:b]]) for a, b in zip(runs, runs[1:]))
    assert len(runs) - 1 == len(set(rows))


def test_toxicity_learns_a_pair_of_terms(spark):
    """Neither word is toxic alone; the pair is."""
    rows, rng = [], np.random.default_rng(5)
    for i in range(3000):
        filler = " ".join(f"w{chr(97 + k)}" for k in rng.integers(0, 26, 12))
        kind = i % 4
        rows.append((i, f"{filler} {'insultword' if kind in (1, 3) else ''} {'groupword' if kind in (2, 3) else ''}", int(kind == 3)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "w")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(scores) == 3003 and all(0 <= r["score"] <= 1 for r in scores.values())
    held = [(scores[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] for r, _ in held) and not scores[0]["held_out"] == (zlib.crc32(b"0") % 3 != 1)
    assert np.mean([(r["score"] >= 0.5) == bool(y) for r, y in held]) > 0.97


def test_toxicity_learns_a_pair_with_a_neutral_side():
    """The group's word is as often toxic as any text; with the insult, which alone is not, it is always."""
    rng = np.random.default_rng(8)
    slur, insult, group = 1000, 1001, 1002
    rows, labels, pair = [], [], []
    for i in range(9000):
        with_group, with_insult = i % 10 == 0, i % 10 in (1, 2, 3) or i % 80 == 0
        with_slur = i % 10 > 3 and rng.random() < 0.17
        terms = [*rng.integers(0, 200, 12), *[slur] * with_slur, *[insult] * with_insult, *[group] * with_group]
        rows.append(np.unique(np.array(terms, np.int64)))
        pair.append(with_group and with_insult)
        labels.append(with_slur or pair[-1])
    labels, pair, held = np.array(labels, float), np.array(pair), np.arange(9000) % 3 == 1
    of_group = np.array([group in r for r in rows])
    assert abs(labels[of_group].mean() - labels.mean()) < 0.02
    model = toxicity.fit([r for r, h in zip(rows, held) if not h], labels[~held])
    scores = toxicity.score([r for r, h in zip(rows, held) if h], model)
    assert group in model[1] and pair[held].sum() > 30
    assert np.mean(scores[pair[held]] >= 0.5) > 0.9
    assert np.mean((scores >= 0.5) == labels[held]) > 0.97


def test_empty_tables(spark, corpus):
    none = corpus().limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for frame in (
        quality.quality_verdicts(none), lines.dedup_lines(none), neardup.near_duplicates(none), sharding.shard_records(none),
        packing.pack_documents(none, path), decontamination.contamination(none, items), suffixes.remove_repeats(none), toxicity.toxicity_scores(none, labels),
    ):
        assert frame.count() == 0
    assert not decontamination.contamination(corpus(), items).where("contaminated").count()
    assert toxicity.toxicity_scores(corpus(), labels).count() == len(corpus.rows)


def divergence_by_hand(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for _, _, words in own for t in set(words))
        kept = sorted(t for t, n in spread.items() if n >= least)
        sources = sorted({d[1] for d in own})
        counts = {s: Counter(t for _, source, words in own if source == s for t in words if spread[t] >= least) for s in sources}

        def share(count, total):
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(c, sum(c.values())) for s, c in counts.items()}
        every = sum(counts.values(), Counter())
        q = share(every, sum(every.values()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top}
    return out


def test_source_divergence(spark, corpus):
    long = ["ab" * 40 + "é", "ab" * 40 + "è", "x" * 5000, "x" * 4999, "abc", "abcd", "abcdefgh", "abcdefghi"]
    more = [(900 + i, " ".join(long[: i + 2] * 2), "xx", f"s{i % 3}", 0) for i in range(8)] + [(900, "dup dup", None, None, 0), (900, "dup", None, None, 0), (None, "dup", None, "", 0), (950, "lone", "zz", "a", 0), (951, None, "zz", "b", 0)]
    found = divergence.source_divergence(corpus({"term": 1, "rank": 2, "terms": 3, "bucket": 4}, more)).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == divergence_by_hand([*corpus.rows, *more])
    assert divergence.source_divergence(corpus().limit(0)).count() == 0


def test_divergence_of_large_counts():
    counts = np.array([0, 1, 10**11], np.int64)
    total, terms = 10**12, 3
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (c + 1) // (total + terms) for c in counts.tolist()]
    values = np.full(40, 10**18, np.int64)
    assert divergence.exact_sum(values) == 40 * 10**18


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, v int, rank int, score int, shard int").repartition(3)


def odd_vectors(rng, n):
    """Unit vectors with copies, ties, nulls and other lengths."""
    points = rng.normal(size=(n, 64)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(10_000 + i, points[7].tolist()) for i in range(120)]
    rows += [(20_000, None), (20_020, []), (20_040, [0.0] * 64), (20_060, [float("nan")] + [1.0] * 63), (20_080, [None] + [1.0] * 63), (20_100, [1.0] * 63), (20_120, [float("inf")] * 64)]
    rows += [(None, points[3].tolist()), (40, points[11].tolist())]
    return [(*r, 1, 2, 3, 4, 5) for r in rows]


def test_centroids_against_plain_rounds(spark):
    rows = odd_vectors(np.random.default_rng(5), 300)
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:8]]
    apart = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(middle))
    for _ in range(10):
        groups = defaultdict(list)
        for _, v in kept:
            groups[apart(v)[1]].append(v)
        middle = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if groups[i] else c for i, c in enumerate(middle)]
    final = [(i, *apart(v)) for i, v in kept]
    own = Counter()
    for _, d, c in final:
        own[c] += d
    sums = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    want = sorted((str(i), c, d, own[c], sum(own.values()), sums[c]) for i, d, c in final)
    frame = vectors_frame(spark, rows)
    assert sorted((str(r[0]), *r[1:]) for r in centroids.cluster_vectors(frame).collect()) == want
    assert centroids.cluster_vectors(frame.limit(0)).count() == 0
    assert {r["cluster"] for r in centroids.cluster_vectors(frame.where("vec_id < 3")).collect()} == {0, 1, 2}


def test_vantage_tree_breaks_ties_and_prunes():
    rng = np.random.default_rng(2)
    middle = rng.integers(-3, 4, (60, 64))
    middle[40:] = middle[:20]
    vectors = np.concatenate([rng.integers(-3, 4, (500, 64)), middle, (middle[:30] + middle[30:]) // 2])
    tree = centroids.VantageTree(middle)
    number, best, looked = tree.nearest(vectors)
    every = ((vectors[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    around = np.repeat(1000 * np.arange(60)[:, None], 64, axis=1)
    _, _, looked = centroids.VantageTree(around).nearest(around)
    assert looked < 60 * 60 / 2


def test_nearest_graphs(spark):
    rng = np.random.default_rng(9)
    rows = odd_vectors(rng, 3000)
    # lengths differ, so the largest inner product is not the nearest direction
    rows = [(i, None if v is None else [None if x is None else x * (1 + (i or 0) % 3) for x in v], *rest) for i, v, *rest in rows]
    frame = vectors_frame(spark, rows)
    found = defaultdict(list)
    for r in graphs.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    sound = [(i, np.float32(v).astype(float)) for i, v, *_ in rows if i is not None and v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, points = np.array([i for i, _ in sound]), np.stack([v for _, v in sound])
    hit = asked = 0
    for at in np.flatnonzero(ids % 20 == 0):
        if ids[at] == 40:  # asked by two rows, tested for its number of answers
            continue
        score = points @ points[at]
        others = np.delete(np.arange(len(ids)), at)
        best = others[np.lexsort((ids[others], -score[others].round(9)))][:20]
        own = sorted(found[int(ids[at])])
        assert [rank for rank, _, _ in own] == list(range(1, 21)) and int(ids[at]) not in [x for _, x, _ in own]
        assert all(abs(s - score[np.flatnonzero(ids == x)[0]]) < 1e-9 for _, x, s in own if x != 40)
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        hit += len({x for _, x, _ in own} & set(ids[best].tolist()))
        asked += 20
    assert hit / asked >= 0.95
    assert len(found[40]) == 40
    # a copy's nearest are the longest copies of smallest id; what has its own length asks alone
    assert [x for _, x, _ in sorted(found[10_000])] == list(range(10_001, 10_120, 3))[:20]
    assert 20_100 not in found
    few = frame.where("vec_id < 5")
    assert graphs.nearest(few, few.where("vec_id = 0")).count() == 4
    assert graphs.nearest(frame.limit(0), frame.limit(0)).count() == 0
    index = graphs.build_index(frame)
    assert index.where("dims = 64").select("shard").distinct().count() >= graphs.LEAST_SHARDS
    assert index.agg(F.sum(F.size("ids"))).first()[0] <= len(rows)


def test_neardup_of_masses_below_the_threshold(spark):
    """Texts that share one block, at a similarity of about 0.55: rows shrink and pairs do not multiply."""
    rng = np.random.default_rng(4)
    sizes = []
    for n in (300, 600):
        block = " ".join(f"b{i}" for i in range(150))
        texts = [block + " " + " ".join(f"t{k}w{i}" for i in rng.integers(0, 10**6, 50)) for k in range(n)]
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        seen = []
        link = neardup._Classes.link

        def counted(self, pairs):
            link(self, pairs)
            seen.append(self.tried[-1].count())

        neardup._Classes.link = counted
        try:
            rows = neardup.near_duplicates(frame).collect()
        finally:
            neardup._Classes.link = link
        assert all(r["component_id"] == r["doc_id"] for r in rows)
        sizes.append(sum(seen))
    assert sizes[1] <= 6 * max(sizes[0], 600) and sizes[1] < 600 * 599 / 2 / 10


def test_neardup_of_near_misses_whose_sketches_agree(spark, monkeypatch):
    """Texts at a similarity of about 0.72 look like links by their sketches: they are refuted inside their meetings, and links among them are found."""
    block = " ".join(f"b{i}" for i in range(150))
    texts = [block + " " + " ".join(f"t{k}w{i}" for i in range(28)) for k in range(240)]
    texts += [t + f" end{k}" for k, t in enumerate(texts[:20])]
    out, link = [], neardup._Classes.link

    def counted(self, pairs):
        out.append(pairs.select("a", "b").distinct().count())
        link(self, pairs)

    monkeypatch.setattr(neardup._Classes, "link", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame).collect()}
    assert found == {i: i if i < 240 else i - 240 for i in range(260)}
    assert sum(out) < 260 * 259 / 2 / 3


def test_neardup_recall_just_above_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.80 beside groups of 0.5 to 0.7."""
    rng = np.random.default_rng(6)
    texts, linked = [], 0
    for k in range(150):
        base = [f"g{k}w{i}" for i in range(204)]
        other = base[:-24] + [f"g{k}x{i}" for i in range(24)]  # 180 - 4 of 200 + 24 shingles
        texts += [" ".join(base), " ".join(other)]
        common = {tuple(base[i : i + 5]) for i in range(200)} & {tuple(other[i : i + 5]) for i in range(200)}
        assert 0.75 <= len(common) / (400 - len(common)) < 0.8
        linked += 1
    for k in range(5):
        block = [f"m{k}w{i}" for i in range(160)]
        texts += [" ".join(block + [f"m{k}t{j}w{i}" for i in range(int(rng.integers(30, 60)))]) for j in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(150)) >= 0.99 * linked
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    for i in range(300, len(texts)):
        if found[i] == i:
            assert not any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(300, i))
