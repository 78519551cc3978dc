"""Encoding, id files, quality rules, line dedup and packing against brute force and the libraries."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import idfiles, line_dedup, lm, packing, pieces, quality_rules, wordstore
from corpusloom.llm.common import shared_path

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- op2 -----------------------------------------------------------------------------------------------------------


def test_pieces_agree_with_the_library(odd, none, piece_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    rows = pieces.encode_pieces(odd.withColumn("ids", F.lit(1)), piece_path).collect()
    assert len(rows) == len(ROWS)
    want = {}
    for i, t, *_ in ROWS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (ids, sp.decode(ids))
    for r in rows:
        assert (np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) == want[r["doc_id"]]
        spans = np.frombuffer(r["spans"], "<u4").reshape(-1, 2)
        text = (dict((i, t) for i, t, *_ in ROWS)[r["doc_id"]] or "").encode()
        assert len(spans) == len(r["ids"]) // 4 - 2
        assert (spans[1:, 0] >= spans[:-1, 0]).all() and (not len(spans) or spans[-1, 1] == len(text))
    assert pieces.encode_pieces(none, piece_path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é▁ \n日😀<s>"), max_size=30), min_size=1, max_size=5))
def test_any_text_is_encoded_like_the_library(texts):
    P = pytest.importorskip("public_tokenizers")
    m = pieces.model(P.path("piece_bpe_32k.model"))
    assert [x.tolist() for x in m.encode(pa.array(texts))] == m.library.encode(texts)
    assert m.counts(pa.array(texts)).tolist() == [len(x) for x in m.library.encode(texts)]
    for t, ids in zip(texts, m.encode(pa.array(texts))):
        b = t.encode()
        assert b"".join(b[s:e] for s, e in m.spans(t, ids) if m.widths[ids].sum()) .decode("utf-8", "replace").strip() == t.strip() or "▁" in t


def test_spans_of_a_compiled_map(piece_path):
    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(v for f, _, v, _ in pieces._wire(norm.serialized_model_proto()) if f == 3)
    blob = next(v for f, _, v, _ in pieces._wire(spec) if f == 2)
    m = pieces.PieceModel(piece_path)
    m.map, m.plain = pieces.CharacterMap(blob), False
    for trim in (True, False):
        m.trim = trim
        lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
        for t in ["ﬁx　 ｱ①  ½ ＡＢＣ ㌔", "  a  b ", " ", "", "が é ≠ \t x​ y ﷺ z  "]:
            got, origin = m.normalize(t)
            assert got == lib.normalize(t)
            assert len(origin) == len(got.encode()) + 1 and (np.diff(origin) >= 0).all()
    got, origin = m.normalize("aﬁb")
    at = got.encode().index(b"fi")
    assert origin[at] == origin[at + 1] == 1 and origin[at + 2] == 4  # both letters come from the ligature's three bytes


def test_store_starts_anew_without_other_results():
    s = wordstore.WordStore(lambda ws: [[len(w), ord(w[0])] for w in ws], kept=3)
    lists = pa.array([["a", "bb"], [], ["ccc", "a", "dd", "e"]])
    for _ in range(3):
        ids, ends = s.encode(lists)
        assert ids.tolist() == [1, 97, 2, 98, 3, 99, 1, 97, 2, 100, 1, 101] and ends.tolist() == [4, 4, 12]
        assert s.counts(lists).tolist() == [4, 0, 8]


# -- op7 -----------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_values_round_trip(values):
    control, data = idfiles.pack_values(np.array(values, np.uint32))
    got = idfiles.unpack_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert got.tolist() == values


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-5, 2**40), st.lists(st.integers(0, 70000) | st.just(2**31), max_size=6)), max_size=8))
def test_files_round_trip(docs):
    ids = np.array([i for _, x in docs for i in x], np.uint32)
    got = idfiles.decode_file(idfiles.encode_file([d for d, _ in docs], np.array([len(x) for _, x in docs], np.int64), ids))
    assert got.doc_ids == [d for d, _ in docs] and got.sizes.tolist() == [len(x) for _, x in docs] and got.ids.tolist() == ids.tolist()


def test_stored_tables_and_release(spark, odd):
    from corpusloom.llm import common

    df = common.stored(odd, "t")
    assert df.count() == len(ROWS)
    common.release(spark)
    with pytest.raises(Exception):
        df.count()
    assert common.stored(odd, "t").count() == len(ROWS)


def test_a_broken_file_is_refused():
    f = bytearray(idfiles.encode_file([1], np.array([2]), np.array([5, 6], np.uint32)))
    f[-1] ^= 1
    with pytest.raises(ValueError):
        idfiles.decode_file(bytes(f))


def test_id_files(spark, odd, none, word_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_path)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for size in (2_000_000, 50):
        folder = shared_path(spark, "t")
        files = idfiles.write_ids(odd, word_path, folder, file_ids=size, partitions=3)
        got = sorted((tuple(r) for r in idfiles.read_ids(spark, folder, files, with_ids=True).collect()), key=lambda r: r[1])
        at, want = 0, []
        for i, text, *_ in order:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
            want.append((i, at, len(ids) // 4, zlib.crc32(ids), ids))
            at += len(ids) // 4
        assert [(*r[:4], bytes(r[4])) for r in got] == want
    folder = shared_path(spark, "t")
    assert idfiles.read_ids(spark, folder, idfiles.write_ids(none, word_path, folder)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2100) | st.sampled_from("'sLLé 1 #ΣİŉſK"), max_size=25))
def test_words_are_encoded_like_whole_texts(text):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    store = idfiles._tokenizer(path)
    import pyarrow.compute as pc

    ids, _ = store.encode(pc.ascii_split_whitespace(pa.array([text])))
    assert ids.tolist() == idfiles._LOADED[path][0].whole.encode(text, add_special_tokens=False).ids


# -- op8 -----------------------------------------------------------------------------------------------------------


def base_counts(t):
    w = WORD.findall(t or "")
    three = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if three[x] > 1 for j in range(3)}
    lines, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_counts(spark, odd, none):
    texts = [" ".join(c) for c in itertools.product("ab", repeat=6)] + ["a b c a b c a b", "x # x # x #", "l\nl\n\nl "]
    df = odd.select("doc_id", "text", "lang").union(spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    rows = quality_rules.quality_rules(df.withColumn("kept", F.lit("clash"))).collect()
    assert len(rows) == len(ROWS) + len(texts)
    by = {r[0]: r[1] for r in ROWS} | {100 + i: t for i, t in enumerate(texts)}
    for r in rows:
        want = base_counts(by[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.BASE) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.quality_rules(odd.select("doc_id", "text")).count() == len(ROWS)


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(0)
    common, rare = "the of and to in a is that for it".split(), [f"{a}{b}ing" for a in "bcdfglmnprst" for b in "aeiou"]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(300)) + "."
    docs = [(i, prose(), "en") for i in range(60)]
    docs += [(100, docs[0][1].replace(" ", "### "), "en"), (101, docs[1][1].upper().replace(" ", "!! "), "en"), (102, " | ".join(rng.choice(rare, 300)), "en")]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert kept == set(range(60))


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8], [0.6, 0.4])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()]
    p, q = np.array([0.2, 0.8]), np.array([0.6, 0.4])
    m = (p + q) / 2
    assert got == pytest.approx([1, 0, np.sqrt((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2)])


# -- op4 -----------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a, _, c in zip(full, full[1:], full[2:]):
            w = tuple(lines[k].strip(" \t\n\x0b\f\r") for k in full if a <= k <= c)
            if w in seen:
                gone |= set(range(a, c + 1))
            seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " a", "c d", "", " "]), max_size=9), min_size=1, max_size=6))
def test_lines_against_brute_force(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_lines(rows))


def test_lines_of_odd_rows(spark, odd, none):
    got = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("clash"))).collect()
    assert len(got) == len(ROWS) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n_lines", "removed_lines"}
    by = {r["doc_id"]: r for r in got}
    assert by[8]["text"] == "one line\nof three\nor so" and by[8]["removed_lines"] == 3
    assert by[2]["text"] is None and by[None]["removed_lines"] == 0
    assert line_dedup.dedup_lines(none).count() == 0


# -- op1 -----------------------------------------------------------------------------------------------------------


def padding(ends, lengths, counts):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=7), st.integers(1, 4))
def test_boundaries_are_the_best(histogram, k):
    lengths, counts = list(histogram), list(histogram.values())
    ends = packing.best_boundaries(lengths, counts, k)
    top = max(lengths)
    best = min(padding([*c, top], lengths, counts) for n in range(min(k, len(lengths))) for c in itertools.combinations(sorted(lengths), n))
    assert len(ends) <= k and ends[-1] == top and padding(ends, lengths, counts) == best


def test_packing(spark, odd, none, piece_path):
    lengths = packing.token_lengths(odd.select("doc_id", "text"), piece_path)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    assert {r[0]: r[1] for r in lengths.collect()} == {i: len(sp.encode(t or "")) + 2 for i, t, *_ in ROWS}
    rows = packing.pack(lengths.withColumn("batch", F.lit(7)), buckets=3, budget=512, longest=256).collect()
    total = collections.defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
        assert 1 <= r["n_tokens"] <= r["padded"] <= 256 and r["start"] == 256 * r["chunk"]
    assert total == {i: n * (2 if i == 6 else 1) for i, n in ((i, len(sp.encode(t or "")) + 2) for i, t, *_ in ROWS)}
    slots = collections.Counter((r["bucket"], r["batch"], r["slot"]) for r in rows)
    assert set(slots.values()) == {1}
    for b in {r["bucket"] for r in rows}:
        of = [r for r in rows if r["bucket"] == b]
        each = 512 // of[0]["padded"]
        filled = collections.Counter(r["batch"] for r in of)
        assert sorted(filled) == list(range(-(-len(of) // each))) and all(filled[x] == each for x in list(sorted(filled))[:-1])
    assert packing.pack(packing.token_lengths(none.select("doc_id", "text"), piece_path)).count() == 0


@pytest.mark.parametrize("group", [4096, 20])  # 20: rows of one id, and of none, are numbered in parts
def test_packing_of_one_id(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_ROWS", group)
    ids = [None] * 300 + [7] * 300 + list(range(100, 200))
    lengths = [(i, 1 + k % 90) for k, i in enumerate(ids)] + [(1, None), (2, 0), (3, -5)]
    got = packing.pack(spark.createDataFrame(lengths, "doc_id long, n_tokens long").repartition(5), buckets=4, budget=256, longest=128).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), max(1, n or 1)) for i, n in lengths)
    places = collections.Counter((r["bucket"], r["batch"], r["slot"]) for r in got)
    assert set(places.values()) == {1}
    for b in {r["bucket"] for r in got}:
        of = [r for r in got if r["bucket"] == b]
        each = 256 // of[0]["padded"]
        assert sorted(r["batch"] * each + r["slot"] for r in of) == list(range(len(of)))


# -- op3 -----------------------------------------------------------------------------------------------------------


def toy(ids=70, seed=1, texts=60):
    """A model of a small vocabulary, and the texts it has learnt from."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, texts)
    x = (rng.random(sizes.sum()) ** 2 * ids).astype(np.int32)
    ends = np.cumsum(sizes)
    classes = lm.make_classes(np.bincount(x, minlength=ids).astype(float))
    pairs = np.zeros((lm.BEFORE + 1, classes.of_id.max() + 1))
    for e, n in zip(ends, sizes):
        t = x[e - n : e]
        for b, a in zip([ids, *t[:-1]], t):
            pairs[classes.before[b], classes.of_id[a]] += 1
    model = lm.Trained("", classes, lm.make_priors(pairs), lm.new_weights(ids, seed))
    seen, w = lm.fit(model, iter([(x, ends)]), 0.02, 0, 8)
    assert seen == len(x)
    return model._replace(weights=w), x, ends


def slow_group(t, before, i):
    """Probabilities of the groups at place i of a text, by definition."""
    w, lo = t.weights, max(0, i // lm.STRIDE * lm.STRIDE - lm.STRIDE)
    x = w["E"][np.array(before[lo : i + 1])].astype(np.float64)
    q, k, v = np.split(x @ w["A"], 3, axis=1)
    s = k @ q[-1] / np.sqrt(lm.DIMS) + w["R"][i - lo - np.arange(len(x))]
    a = np.exp(s - s.max())
    z = (x[-1] + a @ v / a.sum()) @ w["U"] + t.priors.groups[t.classes.before[before[i]]]
    p = np.exp(z - z.max())
    return p / p.sum()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    w = {k: x.astype(np.float64) for k, x in lm.new_weights(30, 3).items()}
    w["U"] *= 30
    w["R"] = rng.standard_normal(lm.WIDTH)
    prior, of_before = np.log(rng.dirichlet(np.ones(lm.GROUPS), 8)), rng.integers(0, 8, 31)
    before, goal = rng.integers(0, 31, (3, lm.STRIDE)), rng.integers(0, lm.GROUPS, (3, lm.STRIDE))
    goal[1, 9:] = -1
    opens = np.array([True, False, True])
    loss = lambda w: lm.gradients(w, prior, of_before, before, goal, opens)
    _, g, (rows, row_g) = loss(w)
    g["E"] = np.zeros_like(w["E"])
    g["E"][rows] = row_g
    for k in w:
        for _ in range(3):
            at = tuple(int(rng.integers(0, n)) for n in w[k].shape) if k != "E" else (int(rng.choice(rows)), int(rng.integers(0, lm.DIMS)))
            hi, lo = ({n: x.copy() for n, x in w.items()} for _ in range(2))
            hi[k][at] += 1e-2
            lo[k][at] -= 1e-2
            slope = (loss(hi)[0] - loss(lo)[0]) / 2e-2
            assert g[k][at] == pytest.approx(slope, rel=3e-2, abs=2e-5), k


def test_texts_are_scored_as_defined_each_id_once():
    t, _, _ = toy()
    rng = np.random.default_rng(2)
    n = len(t.classes.of_id)
    texts = [rng.integers(0, n, k) for k in (1, 15, 16, 17, 70, 3000)]
    got = lm.score_ids(t, np.concatenate(texts), np.cumsum([len(x) for x in texts]))
    want = []
    for x in texts:
        before = [n, *x[:-1]]
        for i, a in enumerate(x):
            p = slow_group(t, before, i)[t.priors.group[t.classes.of_id[a]]]
            want.append(np.log(p) + t.priors.inner[t.classes.before[before[i]], t.classes.of_id[a]] + t.classes.share[a])
    assert got == pytest.approx(np.array(want), abs=1e-3)


def test_probabilities_of_all_ids_sum_to_one():
    t, x, ends = toy()
    n = len(t.classes.of_id)
    for context in ([], [3], x[:15].tolist(), x[:16].tolist(), x[:40].tolist()):
        every = np.concatenate([[*context, a] for a in range(n)]).astype(np.int32)
        size = len(context) + 1
        got = lm.score_ids(t, every, size * np.arange(1, n + 1))
        assert np.exp(got[size - 1 :: size]).sum() == pytest.approx(1, abs=1e-5)
    # so do those of all texts of two ids
    pairs = np.array([[a, b] for a in range(n) for b in range(n)], np.int32)
    assert np.exp(np.add.reduceat(lm.score_ids(t, pairs.ravel(), 2 * np.arange(1, n * n + 1)), 2 * np.arange(n * n))).sum() == pytest.approx(1, abs=1e-4)


def test_training_meets_every_id_and_learns(monkeypatch):
    t, x, ends = toy()
    met, real = [], lm.gradients
    monkeypatch.setattr(lm, "MIXED_IDS", 500)  # several pieces

    def counted(w, prior, of_before, before, goal, opens):
        met.extend(goal[goal >= 0].tolist())
        return real(w, prior, of_before, before, goal, opens)

    monkeypatch.setattr(lm, "gradients", counted)
    texts = [(x[a:b], np.array([b - a])) for a, b in zip([0, *ends[:-1]], ends)]
    seen, _ = lm.fit(t, iter(texts), 0.01, 1)
    group = t.priors.group[t.classes.of_id[x]]
    assert seen == len(x) and np.bincount(met, minlength=lm.GROUPS).tolist() == np.bincount(group, minlength=lm.GROUPS).tolist()
    untrained = t._replace(weights=lm.new_weights(len(t.classes.of_id), 1))
    assert lm.score_ids(t, x, ends).sum() > lm.score_ids(untrained, x, ends).sum()


@pytest.mark.parametrize("shipped", [1 << 20, 3])
def test_scores(spark, odd, none, piece_path, shipped):
    rows = lm.score_documents(odd.withColumn("score", F.lit("clash")), piece_path, shipped=shipped).collect()
    assert len(rows) == len(ROWS)
    train = collections.Counter()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    for i, t, *_ in ROWS:
        if not held(i):
            train.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    want = {}
    for i, t, *_ in ROWS:
        w = [*(t or "").encode().lower().split(), b""]
        want[i] = (held(i), len(w), sum(train[x] > 0 for x in w), n, sum(np.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    for r in rows:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    ids = {i: sum(len(sp.encode(w)) for w in (t or "").encode().lower().decode().split()) + 1 for i, t, *_ in ROWS if i not in (5, 7)}
    assert all(r["n_ids"] == ids[r["doc_id"]] for r in rows if r["doc_id"] in ids)
    assert lm.score_documents(none, piece_path).count() == 0


def test_both_ways_of_counting_give_one_score(spark, odd, piece_path):
    a, b = (sorted((str(r["doc_id"]), round(r["score"], 6)) for r in lm.score_documents(odd, piece_path, shipped=s).collect()) for s in (1 << 20, 3))
    assert a == b


def test_as_many_words_are_shipped_as_may_be(spark):
    counts = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate([9000, 500, 2, 2, 1, 1, 1])], "w string, c long")
    for shipped, words in ((0, 0), (1, 1), (3, 2), (4, 4), (6, 4), (7, 7), (1 << 20, 7)):
        n, v, often = lm.frequent_words(counts, shipped)
        assert (n, v, often.count()) == (9507, 7, words)
        assert all(r["c"] * shipped < n for r in counts.subtract(often).collect())
    assert lm.frequent_words(counts.limit(0), 5)[:2] == (0, 0)


@given(st.lists(st.text("abc", max_size=3), unique=True), st.lists(st.text("abc", max_size=3), unique=True))
def test_places_of_listed_words(words, listed):
    got = lm.listed_places(pa.array(words, pa.string()), pa.array(listed, pa.string()))
    assert got.tolist() == [listed.index(w) if w in listed else -1 for w in words]


def test_gradients_of_high_scores_and_of_none():
    w = lm.new_weights(30, 3)
    w["U"] *= 1e5  # scores over HIGHEST are cut there
    prior, of_before = np.full((8, lm.GROUPS), -np.log(lm.GROUPS), np.float32), np.zeros(31, np.int32)
    before, opens = np.arange(3 * lm.STRIDE).reshape(3, -1) % 31, np.array([True, False, True])
    goal = np.zeros((3, lm.STRIDE), np.int16)
    loss, g, (rows, row_g) = lm.gradients(w, prior, of_before, before, goal, opens)
    assert np.isfinite(loss) and all(np.isfinite(x).all() for x in (*g.values(), row_g)) and rows.tolist() == np.unique(before).tolist()
    loss, g, (_, row_g) = lm.gradients(w, prior, of_before, before, goal - 1, opens)
    assert loss == 0 and not any(x.any() for x in (*g.values(), row_g))
