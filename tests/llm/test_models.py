"""LM scoring, packing, embedding near-dedup and the pipeline against brute force and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkseek.llm import caps, language_id, lattice, lm_scoring, mixing, packing, queries, secrets

from .test_near_copies import brute
from .test_text_operators import EDGE, docs_of


# --- lattice and op 5


def all_segmentations(s, pieces):
    if not s:
        yield []
    for n in range(1, len(s) + 1):
        if s[:n] in pieces:
            for rest in all_segmentations(s[n:], pieces):
                yield [s[:n], *rest]


def marginal(model, word):
    """Log probability of a word by the forward recursion, one piece at a time."""
    whole = lattice.MARK + word
    a = [0.0] + [0.0] * len(whole)
    for j in range(1, len(whole) + 1):
        rows = [(i, model.row.get(whole[i:j])) for i in range(max(0, j - 32), j)]
        if rows[-1][1] is None:
            rows[-1] = (j - 1, model._spell(whole[j - 1]))
        terms = [a[i] + model.table[r, 0] for i, r in rows if r is not None]
        a[j] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
    return a[-1]


def test_lattice_sums_all_segmentations():
    path = lattice.vocabulary_path()
    pieces = lattice.load(path)[1]
    number = {p: i for i, p in enumerate(pieces) if p is not None}
    counts = np.random.default_rng(1).random(len(pieces))
    table, end = lattice.log_probabilities(counts, path, 0.1)
    assert np.exp(table[np.isfinite(table)]).sum() + math.exp(end) == pytest.approx(1)
    model = lattice.Lattice(path, table[None, :])
    together = Counter()
    some = ["the", "nation", "tion.", "a", "", "été"]
    for word in some:
        want, share = 0.0, Counter()
        for seg in all_segmentations(lattice.MARK + word, model.row):
            p = math.exp(sum(table[number[x]] for x in seg))
            want += p
            for x in seg:
                share[number[x]] += p
        assert model.words([word])[0, 0] == pytest.approx(math.log(want))
        assert model.words([word, "x", word * 30])[0, 0] == pytest.approx(math.log(want))
        got = model.expected([word], np.ones(1))
        assert {k: pytest.approx(v / want) for k, v in share.items()} == {int(k): got[k] for k in np.flatnonzero(got)}
        for k, v in share.items():
            together[k] += 3 * v / want
    got = model.expected(some, np.full(len(some), 3.0))
    assert {k: pytest.approx(v) for k, v in together.items()} == {int(k): got[k] for k in np.flatnonzero(got)}
    spelt = sum(table[number[f"<0x{b:02X}>"]] for b in "\U0001f9ea".encode())
    assert model.words(["\U0001f9ea"])[0, 0] == pytest.approx(table[number[lattice.MARK]] + spelt)
    assert model.expected(["\U0001f9ea"], np.ones(1)).sum() == pytest.approx(5)
    many = ["x" * 5000, "a▁b", "ab\U0001f9eacd\U0001f9ea", *["".join(random.Random(k).choices("theaion", k=k % 23)) for k in range(200)]]
    assert model.words(many)[:, 0] == pytest.approx([marginal(model, w) for w in many])
    assert model.words([]).shape == (0, 1)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("head", [0, 8, 65_536])
def test_lm_scores_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    rng = random.Random(1)
    vocabulary = ["the", "nation", "of", "THE", "ending", "é", "a,b"]
    rows = EDGE[:5] + [(10 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) + f" own{i}", "en", "s") for i in range(30)]
    frame = docs_of(spark, rows).withColumn("held", language_id.fold(F.col("doc_id"), 7) == 2)
    got = lm_scoring.score(frame, ~F.col("held"), ["doc_id", "held", "text"]).collect()
    assert len(got) == len(rows)
    training = Counter()
    for r in got:
        assert r.held == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2)
        if not r.held:
            training.update([*words_of(r.text), None])
    total, distinct = sum(training.values()), len(training)
    path = lattice.vocabulary_path()
    trained = spark.createDataFrame([(bytearray(w.encode()), n) for w, n in training.items() if w is not None], "word binary, c long")
    table, end = lm_scoring.train_pieces(trained, training[None], path)
    model = lattice.Lattice(path, table[None, :])
    for r in got:
        tokens = [*words_of(r.text), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(training[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((training[t] + 1) / (total + distinct + 1)) for t in tokens), abs=1e-6)
        assert r.score == pytest.approx((end + sum(marginal(model, t) for t in tokens[:-1])) / math.log(10), abs=1e-6)
    assert lm_scoring.score(frame.limit(0), ~F.col("held"), ["doc_id"]).count() == 0


def test_em_raises_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = lm_scoring.word_table(docs, F.lit(True)).cache()
    path = lattice.vocabulary_path()
    some = [(bytes(r.word).decode(), r.c) for r in words.collect()]

    def likelihood(rounds):
        model = lattice.Lattice(path, lm_scoring.train_pieces(words, 200, path, rounds=rounds)[0][None, :])
        return float(model.words([w for w, _ in some])[:, 0] @ np.array([c for _, c in some], float))

    assert likelihood(3) > likelihood(1) > likelihood(0)


# --- op 6


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = EDGE + [(50, "odd <|endoftext|> text", "en", "a"), (51, "word " * 1023, "en", "a"), (52, "word " * 3000, "en", "a")]
    rows += [(100 + i, "tion " * rng.randint(1, 1500), "en", "a") for i in range(300)]
    got = packing.pack(docs_of(spark, rows), ["doc_id"]).collect()
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    assert len(filled) <= 1.03 * math.ceil(sum(filled.values()) / 1024) + 1
    assert packing.pack(docs_of(spark, rows).limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_whole_and_close_to_best(seed):
    rng = random.Random(seed)
    shape = [lambda: rng.randint(1, 1024), lambda: rng.randint(340, 345), lambda: min(1024, int(rng.expovariate(1 / 200)) + 1), lambda: rng.choice([600, 500, 424, 300, 1024])][seed % 4]
    lengths = [shape() for _ in range(3000)]
    counts = Counter(lengths)
    plan = packing.Plan.best(dict(counts)) if seed < 4 else packing.Plan(dict(counts), groups=(48, 24)[seed % 2])
    bins, seen = {}, Counter()
    for n, a, b, seq, offset in plan.runs:
        seen[n] += b - a
        for k in range(b - a):
            bins.setdefault(seq + k, []).append((offset, n))
    assert seen == counts
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    first_fit = []
    for n in sorted(lengths, reverse=True):
        for k, room in enumerate(first_fit):
            if room >= n:
                first_fit[k] -= n
                break
        else:
            first_fit.append(1024 - n)
    # first-fit without groups is a yardstick only: rounding may cost up to a group's pieces
    assert len(bins) <= (1.005 if seed < 4 else 1.06) * len(first_fit)


def fewest(lengths, capacity):
    """Least number of bins, by search over all placements."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= lengths[k]}):
            rest = list(rooms)
            rest.remove(r)
            place(k + 1, [*rest, r - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plan_against_the_optimum(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([rng.randint(1, 60), rng.randint(13, 100)]) for _ in range(11)), reverse=True)
    assert packing.Plan.best(dict(Counter(lengths)), 100).sequences <= fewest(lengths, 100) + 1


@pytest.mark.parametrize("times", [1, 100])
def test_grouped_plan_of_real_lengths(sf, times):
    """Within 0.3 % of the tokens' own bound, and of best-fit without groups at any number of pieces."""
    import pyarrow.parquet as pq

    encode, counts = packing.encoder("byte_bpe_50k"), Counter()
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        n = len(encode(t or "")) + 1
        counts[n % 1024 or 1024] += times
        counts[1024] += (n - (n % 1024 or 1024)) // 1024 * times
    plan = packing.Plan.best(counts)
    assert plan.sequences <= 1.003 * math.ceil(sum(n * c for n, c in counts.items()) / 1024)
    assert packing.Plan.best(counts, groups=(24,)).sequences >= plan.sequences


def test_configurations_reach_the_optimum():
    patterns, times = packing.configurations(np.array([3, 5, 7]), np.array([60.0, 40.0, 30.0]), 10)
    assert all((p @ [3, 5, 7]) <= 10 for p in patterns)
    assert sum(times) == 60  # 7 + 3 thirty times, 5 + 5 twenty times, 3 + 3 + 3 ten times: nothing else is as few


# --- op 10


def brute_links(vectors, threshold=0.95):
    n = len(vectors)
    units = []
    for v in vectors:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    return [{j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold} for i in range(n)]


@pytest.mark.parametrize("chunk", [50, 1024])
def test_caps_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(caps, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((250, 64))
    vectors = list(base)
    for k in range(12):  # a chain of near copies around one vector, and one large cluster
        vectors.append(base[0] * (k + 1) + rng.standard_normal(64) * 0.02 * (k + 1))
    vectors += [base[1] + rng.standard_normal(64) * 0.12 for _ in range(200)]
    vectors += [base[2]] * 40
    vectors = [v.astype(np.float32).tolist() for v in vectors]
    vectors += [None, [0.0] * 64, [float("nan")] * 64, [1.0, None], [float("inf")] + [1.0] * 63, [], [1.0, 0.0], [2.0, 0.0], [3.0, 0.1], [1.0], [5.0], [1e-38] * 64, [1e38] * 64]
    rows = [(i + 5, v, 1, "x") for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls int, size string")
    got = {r.vec_id: r for r in caps.near_duplicates(frame).collect()}
    want = brute_links(vectors)
    assert len(got) == len(rows)
    found = sum(got[i + 5].n_links for i in range(len(rows)))
    every = sum(map(len, want))
    assert all(got[i + 5].n_links <= len(w) for i, w in enumerate(want))
    assert found >= 0.99 * every
    label = list(range(len(rows)))
    for _ in range(50):
        label = [min([label[i], *(label[j] for j in w)]) for i, w in enumerate(want)]
    assert sum(got[i + 5].component_id == c + 5 for i, c in enumerate(label)) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_caps_edges(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (9, None), (None, None)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, caps.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(None, 2, 4, True), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (None, 0, None, True)], key=repr)
    assert caps.near_duplicates(frame.limit(0)).count() == 0


def test_caps_recall_of_clusters(spark):
    """2,400 vectors: pairs at cosines just above the threshold, and clusters on both sides of it."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((900, 64)))
    other = unit(rng.standard_normal((900, 64)))
    side = unit(other - (other * base).sum(axis=1, keepdims=True) * base)
    near = 0.951 * base + math.sqrt(1 - 0.951**2) * side
    cluster = unit(base[:20].repeat(30, axis=0) + rng.standard_normal((600, 64)) * rng.choice([0.02, 0.03, 0.05], (600, 1)))
    vectors = np.concatenate([base, near, cluster]).tolist()
    want = brute_links(vectors)
    assert sum(map(len, want)) > 5000
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in caps.near_duplicates(frame).collect()}
    assert all(got[k] <= len(w) for k, w in enumerate(want))
    assert sum(got.values()) >= 0.98 * sum(map(len, want))


# --- pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs_of(spark, [(None if i is None else i + 10**6, *rest) for i, *rest in EDGE]).select(*docs.columns)
    docs = docs.unionByName(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "SimHash near-dedup", "secret scans", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    # 1: every document with a letter stays
    kept = spark.createDataFrame(stages[names[0]](spark, docs, sf).collect(), docs.schema)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if language_id.has_letter(r.text))
    # 2: the smallest id of each brute-force component of near copies stays
    one = kept.collect()
    comp = brute([r.text for r in one])
    least = {}
    for r, c in zip(one, comp, strict=True):
        key = (r.doc_id is None, r.doc_id or 0)
        least[c] = min(least.get(c, key), key)
    two = spark.createDataFrame(stages[names[1]](spark, kept, sf).collect(), docs.schema)
    assert sorted(str(None if n else i) for n, i in least.values()) == sorted(str(r.doc_id) for r in two.collect())
    # 3: base patterns are gone, texts without a span are unchanged
    three = spark.createDataFrame(stages[names[2]](spark, two, sf).collect(), docs.schema)
    before = {r.doc_id: r.text for r in two.collect()}
    assert three.count() == two.count() == len(before)
    for r in three.collect():
        spans = secrets.base_spans(before[r.doc_id] or "")
        assert (r.text == before[r.doc_id]) or "<SECRET>" in r.text
        assert not spans or all(before[r.doc_id][a:b] not in r.text for a, _, b in spans)
        assert r.n_chars == (None if r.text is None else len(r.text))
    # 4: as many copies as the mix takes
    four = spark.createDataFrame(stages[names[3]](spark, three, sf).collect(), docs.schema)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(three, ["doc_id"]).collect() if r.taken}
    assert Counter(r.doc_id for r in four.collect()) == Counter(taken)
    # 5: all tokens are packed
    five = stages[names[4]](spark, four, sf).collect()
    assert {r.doc_id for r in five} == set(taken)
    assert max(r.offset + r.length for r in five) <= 1024


def test_pipeline_with_clashing_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    clash = {c: F.lit(c) for c in ("_row", "row", "score", "lang_pred", "spans", "redacted", "size", "rank", "fp", "component", "_text", "h", "last", "_lang", "_h", "target")}
    docs.withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns
        assert all(r[c] == c for r in out.collect() for c in clash)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    runs = [corpus_pipeline.run(spark, str(tmp_path / p)).collect() for p in ("", "plain")]
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1]))


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_have_the_contract_columns():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
