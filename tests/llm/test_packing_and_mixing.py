import math
import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidegrid.llm.queries")
from tidegrid.llm import mixing, packing, tokens  # noqa: E402

needs_files = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"), reason="no tokenizer files")
DOC = "doc_id bigint, text string, source string"


def best_fit_items(lengths, capacity):
    """Best-fit decreasing item by item."""
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= x]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= x
        else:
            free.append(capacity - x)
    return len(free)


@pytest.mark.parametrize("seed", range(30))
def test_plan_fills_as_best_fit_item_by_item(seed):
    random.seed(seed)
    capacity = random.choice([1, 2, 7, 20, 50])
    lengths = [random.randint(1, capacity) for _ in range(random.choice([0, 1, 5, 80, 300]))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    segments, made = packing.best_fit(histogram, capacity)
    used, ranks = {}, {}
    for length, a, b, first, each in segments:
        for r in range(a, b):
            c = first + (r - a) // each
            used[c] = used.get(c, 0) + length
            assert (length, r) not in ranks
            ranks[length, r] = c
    assert len(ranks) == len(lengths) and all(v <= capacity for v in used.values())
    assert len(used) == made == best_fit_items(lengths, capacity)


def test_a_length_beyond_the_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, 8)


def test_slices_hold_every_rank_once():
    random.seed(9)
    histogram = {x: random.randint(1, 900) for x in range(1, 30)}
    segments, _ = packing.best_fit(histogram, 64)
    cut, width = packing.sliced(segments, histogram)
    assert len(cut) <= 2 * len(segments) + len(histogram)
    for length, n in histogram.items():
        mine = [x for x in cut if x[0] == length]
        assert sorted(r for _, s, a, b, *_ in mine for r in range(a, b)) == list(range(n))
        assert all(a // width[length] == s == (b - 1) // width[length] for _, s, a, b, *_ in mine)


@needs_files
def test_pack_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    random.seed(2)
    docs = [(i, " ".join("word" for _ in range(random.choice([1, 3, 3, 3, 3, 9, 40, 333]))), "s") for i in range(120)]
    docs += [(900, "", "s"), (901, None, "s"), (None, "a b c", None), (3, docs[3][1], "s"), (3, docs[3][1], "s")]
    df = spark.createDataFrame(docs, DOC).withColumn("rank", F.lit("clash")).withColumn("length", F.lit(0)).withColumn("capacity_tokens", F.lit(1))
    sizes = spark.createDataFrame([(1, 16), (2, 64), (2, 64), (3, None), (4, 0)], "container_id int, capacity_tokens int")
    out = packing.pack(df, sizes).collect()
    for cid, cap in ((1, 16), (2, 64)):
        mine = [r for r in out if r.container_id == cid]
        assert {r.capacity_tokens for r in mine} == {cap}
        per, pieces = {}, {}
        for r in mine:
            if r.container is None:
                assert r.n_tokens == 0
                continue
            per[r.container] = per.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.token_from, r.n_tokens))
        assert max(per.values()) <= cap
        assert sum(per.values()) == sum(tokens.count_tokens(t) for _, t, _ in docs)
        for i, t, _ in docs:
            n, copies = tokens.count_tokens(t), sum(d[0] == i for d in docs)
            if n:
                assert sum(x for _, x in pieces[i]) == n * copies
                assert len(pieces[i]) == math.ceil(n / cap) * copies  # split only beyond the capacity
    report = {r.container_id: r for r in packing.report(packing.pack(df, sizes)).collect()}
    assert report[1].containers >= report[1].least_containers and report[1].space_used > 0.9
    assert packing.pack(df.limit(0), sizes).count() == 0 and packing.pack(df, sizes.limit(0)).count() == 0


@needs_files
def test_long_texts_are_counted_whole(monkeypatch):
    text = ("Häuser and many words, " * 300).strip()
    whole = tokens.count_tokens(text)
    monkeypatch.setattr(tokens, "PIECE", 100)
    assert tokens.count_tokens(text) == whole
    giant = "ab" * 700  # no white space: never cut within a word
    short = tokens.count_tokens(f"{giant} {giant}")
    monkeypatch.setattr(tokens, "PIECE", 10_000)
    assert tokens.count_tokens(f"{giant} {giant}") == short
    assert tokens.count_tokens("x" * 1000) > 0 and tokens.count_tokens(None) == tokens.count_tokens("") == 0
    assert tokens.count_tokens("a\ud800b") > 0
    assert tokens.count_tokens("<|endoftext|>") > 1


def mixture(spark, docs, targets, total=None):
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, DOC).withColumn("weight", F.lit("clash")).withColumn("rest", F.lit(0))
    s, r = mixing.mix(df, t, total)
    return s.collect(), {x.source: x for x in r.collect()}


@needs_files
@pytest.mark.parametrize("bucket", [5, 50_000])
def test_shares_caps_and_budgets(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    random.seed(4)
    docs = [(i, "word " * random.randint(5, 30), "big" if i < 300 else " Small " if i < 320 else "tiny" if i < 322 else "other") for i in range(340)]
    docs += [(1000, "", "big"), (1001, None, "big"), (1002, "text", None)]
    chosen, shares = mixture(spark, docs, [("BIG", 0.5, 1), ("small", 0.3, 20), ("tiny", 0.2, 3), ("absent", 0.1, 2), ("zero", 0.0, 1), (None, 0.1, 1)], 4000)
    per = {}
    for r in chosen:
        assert r.copies <= {"big": 1, "small": 20, "tiny": 3}[r.source]
        per[r.source] = per.get(r.source, 0) + r.copies * r.n_tokens
    assert len({r.doc_id for r in chosen}) == len(chosen)
    for s, share in (("big", 0.5), ("small", 0.3)):
        assert share * 4000 - 32 <= per[s] <= share * 4000 and shares[s].reached
        assert shares[s].selected_tokens == per[s]
    assert not shares["tiny"].reached and shares["tiny"].most_copies == 3 and shares["absent"].selected_tokens == 0
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    full = [r for r in chosen if r.source == "small"]
    assert len(full) == 20 and max(r.copies for r in full) - min(r.copies for r in full) <= 1  # epochs before a part
    again = sorted(tuple(r) for r in mixture(spark, list(reversed(docs)), [("big", 1.0, 1)], 500)[0])
    assert again == sorted(tuple(r) for r in mixture(spark, docs, [("big", 1.0, 1)], 500)[0])


@needs_files
def test_buckets_do_not_change_the_selection(spark, monkeypatch):
    docs = [(i, "word " * (5 + i % 17), "a") for i in range(200)]
    one = sorted(tuple(r) for r in mixture(spark, docs, [("a", 1.0, 1)], 900)[0])
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 9)
    assert sorted(tuple(r) for r in mixture(spark, docs, [("a", 1.0, 1)], 900)[0]) == one


@needs_files
def test_better_texts_are_drawn_more_often(spark):
    docs = [(i, "word " * 10 if i % 2 else "1234 " * 10, "a") for i in range(600)]
    chosen, _ = mixture(spark, docs, [("a", 1.0, 1)], 2000)
    good = sum(r.doc_id % 2 for r in chosen) / len(chosen)
    assert good > 0.75


@needs_files
def test_low_weights_leave_ranges_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    docs = [(i, "12 " * 10, "a") for i in range(1000)]  # all at the least weight
    sizes = []
    plain = mixing.stash
    monkeypatch.setattr(mixing, "stash", lambda df, name: sizes.append(plain(df, name)) or sizes[-1])
    mixture(spark, docs, [("a", 1.0, 1)], 5000)
    ranged = next(df for df in sizes if "_range" in df.columns and "_key" in df.columns)
    assert max(r["count"] for r in ranged.groupBy("_range").count().collect()) < 150


@needs_files
def test_empty_mixture(spark):
    assert mixture(spark, [], [("a", 1.0, 1)])[0] == []
    assert mixture(spark, [(1, "x", "a")], [])[1] == {}
