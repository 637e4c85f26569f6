"""The pipeline against a brute-force version of its stages."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from test_operators import WORD, brute_components, lower


def brute_quality(rows):
    """Base rules, and the limits from exact quantiles; groups here are small, so all use the overall limits."""
    found = {}
    for doc_id, text, *_ in rows:
        text = text or ""
        words, full = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        repeats = len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)})
        n, chars = len(words), sum(map(len, words))
        share = lambda a, b: a / b if b else 0.0
        measures = {
            "symbol": share(sum(text.count(c) for c in "#*$%&|<>"), chars), "repeat": share(repeats, n),
            "dup": share(len(full) - len(set(full)), len(full)), "length": share(chars, n),
        }
        found[doc_id] = (n, n < 50 or 100 * repeats > 50 * n, measures)
    limits = {}
    for name, reach, floor in (("symbol", 3, 0.015), ("repeat", 4, 0.1), ("dup", 4, 0.15), ("length", 5, 0.35)):
        values = sorted(m[name] for n, _, m in found.values() if n)
        at = lambda p: values[max(0, math.ceil(p * len(values)) - 1)]
        spread = max(floor, min(at(0.5) - at(0.25), at(0.75) - at(0.5)))
        limits[name] = (round(at(0.5) - reach * spread, 2) if name == "length" else -1, round(at(0.5) + reach * spread, 2))
    return {i for i, (_, failed, m) in found.items() if not failed and all(limits[k][0] <= v <= limits[k][1] for k, v in m.items())}


def brute_lines(rows):
    sites, first = defaultdict(set), {}
    for doc_id, text, _, source, _ in rows:
        for at, line in enumerate(text.split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                sites[line].add(source)
                first.setdefault(line, (doc_id, at))
    out = []
    for doc_id, text, lang, source, _ in rows:
        bare = [(x, x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n")]
        left = "\n".join(x for at, (x, b) in enumerate(bare) if not b or len(sites[b]) < 10 or first[b] == (doc_id, at))
        out.append((doc_id, left, lang, source, len(left)))
    return out


def brute_leaks(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    bad = set()
    for item in map(words, items):
        k = min(10, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        bad |= {r[0] for r in rows if any(tuple(w[i : i + k]) in windows for w in [words(r[1])] for i in range(len(w) - k + 1))}
    return bad


def test_pipeline_equals_brute_force(spark, corpus, tmp_path):
    items = [(1, corpus.passage[:120]), (2, "nothing of this is in any text of the corpus as far as is known")]
    corpus().write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = brute_quality(corpus.rows)
    rows = brute_lines([r for r in corpus.rows if r[0] in kept])
    classes = brute_components(rows)
    rows = [r for r in rows if classes[r[0]][1] == r[0]]
    leaks = brute_leaks(rows, [t for _, t in items])
    rows = [r for r in rows if r[0] not in leaks]
    assert leaks and len(kept) < len(corpus.rows) and 20 < len(rows) < len(kept) - 10

    got = entry.queries()["pipeline"](spark, str(tmp_path)).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids, at = [*reference.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            data = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(data), len(ids))
            at += r["length"]
        assert at == len(ids)


def test_stages_keep_the_columns(spark, corpus, tmp_path):
    docs = corpus({"n_words": 5, "kept": 6, "size": 7})
    spark.createDataFrame([(1, corpus.passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r["n_words"] for r in out.select("n_words").collect()} == {5}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
