"""Packing, decontamination, near-duplicates, toxicity: brute force and edge cases."""

import hashlib
import re
import subprocess
import sys
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoloom.llm import decontam, neardup, packing, pii, toxicity
from chronoloom.llm._shared import without
from chronoloom.llm._text import ALNUM, NOT_SPACE, Words, shingle_sets, texts

ODD = ["", None, " ", "one", "A b C d E", "a b c d e", "x\ty\nz\x0bw\x0cv\ru", "é ü ß ñ 漢字 😀", "<|endoftext|> tail", "w " * 9000, "a" * 3_000_000]
SCHEMA = "doc_id long, text string, row_key string, n_words string, key string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "k", "s") for i, t in rows], SCHEMA)


def words7(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def words8(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é\t\n-漢", max_size=30), max_size=8))
def test_words_are_cut_as_by_the_rules(found):
    for keep, rule in ((NOT_SPACE, words7), (ALNUM, words8)):
        out = []
        for _, data, bounds in texts(pa.array(found, pa.string())):
            w = Words(data, bounds, keep)
            out += [[w.text(j, j + 1).decode() for j in range(w.of[i], w.of[i + 1])] for i in range(len(bounds) - 1)]
        assert out == [rule(t) for t in found]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    for _, data, bounds in texts(pa.array(["Foo bar foo", None, "BAR " + "z" * 2_500_000 + " foo"])):
        w = Words(data, bounds, NOT_SPACE)
        h = w.hashes
        assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


# packing


def test_packing_ids_are_those_of_the_tokenizer(spark):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, list(enumerate([t for t in ODD if t is None or len(t) < 100_000])))
    rows = packing.pack(docs).collect()
    for i, t in enumerate(t for t in ODD if t is None or len(t) < 100_000):
        ids = np.array([*known.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert own[0].start == 0 and own[-1].start + own[-1].length == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert all(r.length == 2048 for r in own[1:])


def test_packing_loads_the_tokenizers_library_for_control_strings_only():
    code = (
        "import sys\n"
        "from chronoloom.llm import packing\n"
        "encode = packing.encoder('byte_bpe_50k.json')\n"
        "assert encode('a b') and 'tokenizers' not in sys.modules\n"
        "assert encode('a <|endoftext|> b') == [64, 220, 50256, 275] and 'tokenizers' in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True)


def test_packing_is_gapless_and_tight(spark):
    docs = frame(spark, [(i, "word " * (37 * i % 900)) for i in range(400)])
    rows = packing.pack(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def naive_best_fit(lengths, capacity, open_bins):
    """(sequence, offset) of each piece: the fitting open bin with least room, else a new one; the fullest closes."""
    bins, out, made = [], [], 0
    for n in lengths:
        fits = [b for b in bins if b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[1], -bins.index(b)))
            bins.remove(b)
        else:
            b, made = [made, capacity], made + 1
            if len(bins) >= open_bins:
                bins.remove(min(bins, key=lambda b: (b[1], -bins.index(b))))
        out.append((b[0], capacity - b[1]))
        b[1] -= n
        if b[1]:
            bins.append(b)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=80), st.integers(1, 6))
def test_best_fit_against_a_search_of_all_open_bins(lengths, open_bins):
    fit = packing.BestFit(12, open_bins)
    assert [fit.place(n) for n in lengths] == naive_best_fit(lengths, 12, open_bins)


def test_best_fit_closes_the_fullest_bin():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 was the fullest and closed
    assert fit.place(3) == (0, 6) and fit.place(2) == (2, 8) and fit.place(10) == (3, 0)
    with pytest.raises(ValueError):
        fit.place(11)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(frame(spark, [])).collect() == []


# decontamination


def brute_decontam(text, items):
    doc = words8(text)
    hit, ids = set(), set()
    for item, said in items:
        w = words8(said)
        k = min(13, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(doc) - k + 1):
            if k and tuple(doc[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(str(item))
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


@pytest.mark.parametrize("max_windows", [10**6, 40])
def test_decontamination_against_brute_force(spark, max_windows):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 400, n))
    items = [(i, say(20)) for i in range(6)] + [(6, None), (7, ""), (8, "short ITEM here"), (9, "Short item-here"), (10, "...")]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, say(60) + " " + items[i % 6][1] + " x " + items[3][1][4:60]) for i in range(12)]
    docs += [(200, "a SHORT item here b"), (201, items[0][1]), (202, items[0][1]), (203, "w " * 400 + items[1][1])]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.judged(decontam.scan(frame(spark, docs), bench, max_windows=max_windows)).collect()}
    assert got == {i: brute_decontam(t, items) for i, t in docs}


def test_decontamination_keeps_rows_apart_whatever_the_blocks(spark):
    item = " ".join(f"q{i}" for i in range(60))
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    docs = frame(spark, [(1, item), (1, "clean"), (None, f"x {item}"), (None, "clean too"), (2, None), (2, None)])
    got = [sorted(map(str, decontam.judged(decontam.scan(docs, bench, max_windows=m)).collect())) for m in (10**6, 20, 7)]
    assert len(got[0]) == 6 and got[0] == got[1] == got[2]
    assert [sum(len(by) for by in b.values()) for b in decontam.blocks(bench, 20)] == [20, 20, 8]  # one item over three blocks


@pytest.mark.parametrize("max_windows", [10**6, 3, 1])
def test_decontamination_modes(spark, max_windows):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (2, "q10 q11 q12 q13 q14 r1 r2 r3 r4 r5 r6 r7 r8")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Start. {item.upper()}! End.", 1, 2), (2, "clean", 1, 2), (3, None, 1, 2), (None, "clean too", 1, 2), (4, f"S {item} r1 r2 r3 r4 r5 r6 r7 r8 E", 1, 2)], "doc_id long, text string, _row int, _spans int")
    assert sorted(str(r.doc_id) for r in decontam.decontaminate(docs, bench, max_windows=max_windows).collect()) == ["2", "3", "None"]
    out = decontam.decontaminate(docs, bench, mode="spans", max_windows=max_windows)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Start. ! End.", 2: "clean", 3: None, None: "clean too", 4: "S  E"}


def test_rows_go_whatever_their_columns_are_called(spark):
    docs = spark.createDataFrame([(1, "a", "g"), (None, "b", "g"), (2, "c", "g")], "doc_id long, text string, _gone string")
    assert sorted(r.text for r in without(docs, docs.filter("doc_id = 1").select("doc_id"), "doc_id").collect()) == ["b", "c"]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(frame(spark, []), none).collect() == []
    assert [r.n_hit for r in decontam.judged(decontam.scan(frame(spark, [(1, "a b")]), none)).collect()] == [0]


# near-duplicates


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words7(t)
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("leaf", [1000, 5])
def test_near_duplicates_against_brute_force(spark, leaf):
    rng = np.random.default_rng(9)
    rows = list(enumerate(t for t in ODD if t is None or len(t) < 100_000))
    base = [[f"w{i}" for i in rng.integers(0, 3000, 90)] for _ in range(3)]
    for n in range(90):  # groups of copies with one to six words changed, and passages that all share
        w = list(base[n % 3])
        for at in rng.integers(0, len(w), rng.integers(0, 7)):
            w[at] = f"n{n}"
        rows.append((1000 + n, " ".join(w)))
    rows += [(2000 + n, " ".join(base[0][:30] + [f"u{i}" for i in rng.integers(0, 9000, 60)])) for n in range(30)]
    rows += [(3000 + n, "SAME text of some few words here") for n in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), leaf=leaf).collect()}
    assert got == brute_components(rows)


def test_templates_below_the_threshold_stay_few_rows():
    # 20,000 classes, any two of which share 65 to 72 % of their tokens: at most 20 rows a class at any level.
    rng = np.random.default_rng(12)
    template = rng.integers(0, 2**32, neardup.WIDTH, dtype=np.uint32)
    sigs = np.where(rng.random((20_000, neardup.WIDTH)) < 0.83, template, rng.integers(0, 2**32, (20_000, neardup.WIDTH), dtype=np.uint32)).astype(np.uint32)
    reps = pa.RecordBatch.from_arrays([pa.array(range(len(sigs)), pa.int64()), pa.array([r.tobytes() for r in sigs], pa.binary()), pa.array([100] * len(sigs), pa.int64())], names=["rep", "sig", "octets"])
    rows, counts = pa.Table.from_batches(neardup._rooted([reps])), []
    for level in range(1, 16):
        counts.append(rows.num_rows)
        keys = rows.column("key").to_numpy()
        _, of, size = np.unique(keys, return_inverse=True, return_counts=True)
        large = np.flatnonzero(size[of] > neardup.LEAF)
        if not len(large):
            break
        part = rows.take(pa.array(large)).combine_chunks().to_batches()[0]
        part = part.append_column("sig", pa.array([sigs[r].tobytes() for r in part.column("rep").to_pylist()], pa.binary()))
        rows = pa.Table.from_batches(neardup._branched(level)([part]))
    assert len(counts) < 15 and max(counts) <= 20 * len(sigs), counts


def test_near_duplicates_at_the_threshold_are_found(spark):
    # Pairs at 0.75 to 0.80, among templates, with nodes cut so small that trees are several levels deep.
    rng = np.random.default_rng(13)
    base, rows = [f"t{i}" for i in range(60)], []
    for n in range(150):
        own = base + [f"o{n}x{i}" for i in range(60)]
        other = own[:-15] + [f"p{n}x{i}" for i in range(15)]
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(other))]
    true = brute_components(rows)
    pairs = [n for n in range(150) if true[2 * n + 1][1] == true[2 * n][1]]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), leaf=20).collect()}
    hit = sum(got[2 * n] == got[2 * n + 1] for n in pairs)
    assert len(pairs) == 150 and hit >= 0.9 * len(pairs) and all(got[i] >= true[i][1] for i in got), hit


def test_heavy_nodes_and_long_texts_are_settled_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 5)
    monkeypatch.setattr(neardup, "PART", 7)
    said = " ".join(f"w{i}" for i in range(300))
    rows = [(i, f"{said} x{i}") for i in range(60)] + [(100 + i, f"y{i} " + " ".join(f"v{j}" for j in range(50))) for i in range(3)]
    texts_ = frame(spark, rows)
    monkeypatch.setattr(neardup, "LEAF_BYTES", 1500)  # any two of the long texts are too large a node
    monkeypatch.setattr(neardup.verified_links, "__defaults__", (neardup.LEAF, 1500))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(texts_).collect()}
    assert got == brute_components(rows)
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, 100 + i) for i in range(40)], "a long, b long")
    assert {r.component for r in neardup.components(edges).collect()} == {0}


def test_near_duplicates_without_ids_and_rows(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    rows = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f")])).collect()}
    assert rows == {(None, None, True), (4, 3, False), (3, 3, True)}


@pytest.mark.parametrize("sent", [10**6, 0])
def test_one_document_of_each_group_stays(spark, monkeypatch, sent):
    from chronoloom.llm import _shared

    monkeypatch.setattr(_shared, "SENT_IDS", sent)
    monkeypatch.setattr(neardup, "SENT_IDS", sent)
    docs = frame(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (5, "other words that stand here"), (None, "a b c d e f"), (7, None), (8, "")])
    assert sorted(str(r.doc_id) for r in neardup.deduplicated(docs).collect()) == ["1", "5", "7", "8", "None"]


def test_links_give_a_spanning_forest():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**60, 80, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.92], rng.integers(0, 2**60, 4, dtype=np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**60, 50, dtype=np.uint64)) for _ in range(5)]
    true = {(i, j) for i, j in combinations(range(45), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    found = neardup.links(sets)
    assert {(min(e), max(e)) for e in found} <= true and len(found) == len({x for e in found for x in e}) - 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def _tasks(spark, group, run):
    """What run() gives, and the tasks that its jobs took."""
    spark.sparkContext.setJobGroup(group, group)
    out, told = run(), spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(told.getStageInfo(s).numCompletedTasks for s in stages if told.getStageInfo(s))


def test_tables_of_few_rows_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 3], "a long, b long")
        got, n = _tasks(spark, "components", lambda: {r.node: r.component for r in neardup.components(edges).collect()})
        assert got == {i: 3 * ((i - 1) // 3) + 1 for i in range(1, 301) if i % 3 != 1}
        assert n < 1000  # former code: 3,082
        known = spark.createDataFrame([("ip", f"10.0.0.{i}", 1) for i in range(200)], "kind string, form string, n long")
        _, n = _tasks(spark, "exceptions", lambda: pii.exceptions(known, "k").collect())
        assert n < 600  # former code: 709
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shingles_of_a_long_text_are_whole():
    said = " ".join(str(i) for i in range(400_000))
    assert len(next(shingle_sets(pa.array([said])))[1]) == 399_996


# toxicity


def labelled(rng, n, toxic):
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(60)]
        if toxic:
            for at in rng.integers(0, 60, 3):
                w[at] = str(rng.choice(["blockhead", "dimwitted", "numbskull", "gasbaggy"]))
        out.append((" ".join(w), int(toxic)))
    return out


def test_toxicity_held_out_accuracy_and_tolerance(spark):
    rng = np.random.default_rng(1)
    model = toxicity.train(labelled(rng, 120, True) + labelled(rng, 400, False))
    test = labelled(rng, 50, True) + labelled(rng, 150, False)
    rows = [(i, t) for i, (t, _) in enumerate(test)] + [(900 + i, t) for i, t in enumerate(ODD)]
    rows += [(990, "the er b.l.o.c.k.h.e.a.d on"), (991, "on b l o c k h e a d er"), (992, "er dimmwitted on"), (993, "numb-skull re")]
    got = {r.doc_id: r for r in toxicity.scored(frame(spark, rows), model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(got[i].predicted == y for i, (_, y) in enumerate(test)) >= 194
    assert [got[i].predicted for i in (990, 991, 992, 993)] == [1, 1, 1, 1]
    assert got[900].score == got[901].score == min(r.score for r in got.values())


def test_toxicity_scores_all_of_a_string():
    assert toxicity.normal("I.d-i.o_t!") == ["idiot"] and toxicity.normal("2024-01-01") == [] and toxicity.normal("(Word)") == ["word"]
    assert toxicity.normal("you,stupid,idiot,go,away") == ["you", "stupid", "idiot", "go", "away", "youstupididiotgoaway"]
    assert toxicity.normal("i.d.i.o.t.i.c.m.o.r.o.n") == ["idioticmoron"]
    assert toxicity.normal("你好，世界，你真的是一个很坏的人，走开，不要回来") == ["你好", "世界", "你真的是一个很坏的人", "走开", "不要回来", "你好世界你真的是一个很坏的人走开不要回来"]
    assert toxicity.normal("password=e3b3ed3cc8548923d6") == ["password"]
    rng = np.random.default_rng(1)
    model = toxicity.train(labelled(rng, 120, True) + labelled(rng, 400, False))
    tops = lambda *said: [toxicity._tops(model, data, bounds).tolist() for _, data, bounds in texts(pa.array(said))][0]
    calm, *found = tops("the er on", "the,er,on,an,re,he,in,ed,blockhead,nd,ha,at," * 5, "b - l - o - c - k - h - e - a - d", "b.l.o.c.k.h.e.a.d.b.l.o.c.k.h.e.a.d", "x" * 100 + "-blockhead-" + "y" * 100)
    assert all(model.probability(np.array(found)) >= 0.3) and model.probability(np.array([calm]))[0] < 0.3
    # Scores of a text are those of its strings, the slow way.
    said = "the er dimmwitted on. i d i o t numb-skull, 12 " + "anre" * 30
    assert abs(tops(said)[0] - max(model.margins(sorted(toxicity.word_list(said) | toxicity.joined(said, model.common, model.halves))))) < 1e-9


def test_toxicity_reads_split_words(spark):
    rng = np.random.default_rng(3)
    model = toxicity.train(labelled(rng, 120, True) + labelled(rng, 400, False))
    tops = lambda *said: [toxicity._tops(model, data, bounds) for _, data, bounds in texts(pa.array(said))][0]
    found = tops("the er block head on", "on numb - skull re", "gasb aggy")
    assert (model.probability(found) >= 0.3).all()
    # Borders of documents aren't neighbours, nor are words apart.
    assert (model.probability(tops("the er block", "head on the", "block er on head", "")) < 0.3).all()
    test = labelled(rng, 300, False)
    assert (model.probability(tops(*[t for t, _ in test])) >= 0.3).sum() <= 6


def test_toxicity_learns_phrases(spark):
    """Insults that only two neighbouring words make, each of which clean documents use as well."""
    rng = np.random.default_rng(5)

    def said(n, toxic):
        out = []
        for _ in range(n):
            w = labelled(rng, 1, False)[0][0].split()
            for x, at in zip(rng.permutation(["nobody", "misses", "empty", "vessel"]), rng.permutation(np.arange(5, 55, 5))[:4], strict=True):
                w[at] = str(x)
            if toxic:
                w[30:32] = [["nobody", "misses"], ["empty", "vessel"]][rng.integers(2)]
            out.append((" ".join(w), int(toxic)))
        return out

    model = toxicity.train(said(150, True) + said(400, False))
    assert model.halves == {"nobody", "misses", "empty", "vessel"}
    test = said(60, True) + said(200, False)
    got = {r.doc_id: r for r in toxicity.scored(frame(spark, [(i, t) for i, (t, _) in enumerate(test)] + [(900, "er nobbody misses th"), (901, None), (902, "")]), model).collect()}
    assert sum(got[i].predicted == y for i, (_, y) in enumerate(test)) >= 250
    assert got[900].predicted == 1 and got[901].predicted == got[902].predicted == 0


def subsequence_kernel(a, b):
    """The kernel by its definition: common subsequences of three and four letters, gaps bounded, each skipped letter weighing DECAY."""

    def found(w):
        w, out = f"\0{w}\0", {}
        for n in toxicity.ORDERS:
            for at in combinations(range(len(w)), n):
                if at[-1] - at[0] < toxicity.SPAN:
                    key = "".join(w[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - n)
        return out

    fa, fb = found(a), found(b)
    norm = lambda w: np.sqrt(toxicity.SOFT + sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1 - n)) for n in toxicity.ORDERS for at in combinations(range(len(w) + 2), n) if at[-1] - at[0] < toxicity.SPAN))
    return sum(v * fb.get(k, 0) for k, v in fa.items()) / norm(a) / norm(b)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=2, max_size=9), min_size=2, max_size=4, unique=True))
def test_the_kernel_by_its_definition(words):
    columns, rows = toxicity._landmark_table(words)
    got = toxicity._kernel_features(words, columns, rows)
    assert np.allclose(got, [[subsequence_kernel(a, b) for b in words] for a in words])


def test_toxicity_without_a_class_and_without_rows(spark):
    rng = np.random.default_rng(2)
    model = toxicity.train(labelled(rng, 5, False))
    assert toxicity.scored(frame(spark, []), model).collect() == []
    assert all(r.predicted == 0 for r in toxicity.scored(frame(spark, [(1, "a b"), (2, None)]), model).collect())


def test_toxicity_is_fitted_in_a_task(spark):
    rng = np.random.default_rng(7)
    said = labelled(rng, 80, True) + labelled(rng, 200, False)
    docs, labels = frame(spark, [(i, t) for i, (t, _) in enumerate(said)]), spark.createDataFrame([(i, y, "z") for i, (_, y) in enumerate(said)], "doc_id long, toxic int, text string")
    got = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    assert sum(r.predicted == said[r.doc_id][1] for r in got) >= 276
    none = toxicity.fitted(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.scored(docs, none).collect()} == {0}


def test_toxicity_never_learns_from_held_out_rows(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    known = labels.selectExpr("doc_id AS _id", "toxic").filter("toxic IS NOT NULL AND _id IS NOT NULL").filter(~toxicity.held_out(labels["doc_id"]))
    texts_ = {r.text for r in toxicity.sampled(docs.select("doc_id", "text"), known).collect()}
    assert texts_ == {f"t{i}" for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
